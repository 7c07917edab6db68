"""Pseudonyms in plain Python, match by match: what the operator is held against."""

import datetime
import hashlib
import re

from colstride.llm import pii

FIRST = datetime.date.fromisoformat(pii.FIRST_DAY)
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), re.ASCII)


class Plain:
    def __init__(self, secret):
        self.secret = secret

    def hex(self, *parts):
        return hashlib.sha256("|".join([self.secret, *map(str, parts)]).encode()).hexdigest()

    def number(self, *parts):
        return int(self.hex(*parts)[:15], 16)

    def feistel(self, a, b, most_a, most_b, *tweak):
        for i in range(pii.ROUNDS):
            if i % 2:
                b = (b + self.number(*tweak, i, a)) % most_b
            else:
                a = (a + self.number(*tweak, i, b)) % most_a
        return a, b

    def digits(self, d, tweak):
        n, cut = len(d), len(d) // 2
        if n < 2:
            return d
        a, b = self.feistel(int(d[:cut]), int(d[cut:]), 10**cut, 10 ** (n - cut), tweak, n)
        return f"{a:0{cut}d}{b:0{n - cut}d}"

    def email(self, v):
        low = v.lower()
        return f"user-{self.hex('email', low)[:12]}@host-{self.hex('domain', low.rpartition('@')[2])[:8]}.invalid"

    def secret_(self, v):
        name = "" if v.startswith("AKIA") else re.match(r"[A-Za-z_]+[\"']?\s*[=:]\s*[\"']?", v, re.ASCII)[0]
        quote = v[-1] if v[-1] in "\"'" else ""
        return f"{name}<secret-{self.hex('secret', v[len(name) : len(v) - len(quote)])[:12]}>{quote}"

    def iban(self, v):
        value = v.replace(" ", "")
        rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if rest(value) != 1:
            return v
        moved = self.digits(re.sub(r"\D", "", value[4:]), "iban")
        body = fill(value[4:], moved)
        return fill(v, f"{98 - rest(value[:2] + '00' + body):02d}" + moved)

    def ip(self, v):
        a, b, c, d = map(int, v.split("."))
        x, y = self.feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    def day(self, n):
        a, b = self.feistel(n // pii.DAYS_RIGHT, n % pii.DAYS_RIGHT, pii.DAYS_LEFT, pii.DAYS_RIGHT, "date")
        return a * pii.DAYS_RIGHT + b

    def dated(self, v, order, walk=False):
        parts, signs = re.findall(r"\d+", v), re.split(r"\d+", v)
        at = {c: int(x) for c, x in zip(order, parts)}
        wide = all(len(x) == 2 for c, x in zip(order, parts) if c != "y")
        try:
            n = (datetime.date(at["y"], at["m"], at["d"]) - FIRST).days
        except ValueError:
            return v
        n = self.day(n)
        while walk and (FIRST + datetime.timedelta(n)).day <= 12:
            n = self.day(n)
        new = FIRST + datetime.timedelta(n)
        short = (lambda x: f"{x:02d}") if wide else str
        new = {"y": str(new.year), "m": short(new.month), "d": short(new.day)}
        return new[order[0]] + signs[1] + new[order[1]] + signs[2] + new[order[2]]

    def ymd(self, v):
        return self.dated(v, "ymd")

    def dmy(self, v):
        return self.dated(v, "dmy")

    def mixed(self, v):
        return self.dated(v, "mdy") if int(re.match(r"\d+", v)[0]) <= 12 else self.dated(v, "dmy", True)

    def named(self, v):
        name, (d, y) = re.search(r"[A-Za-z]+", v)[0], re.findall(r"\d+", v)
        month = [m[:3].lower() for m in pii.MONTHS].index(name[:3].lower()) + 1
        try:
            new = FIRST + datetime.timedelta(self.day((datetime.date(int(y), month, int(d)) - FIRST).days))
        except ValueError:
            return v
        full = pii.MONTHS[new.month - 1]
        full = full if name.capitalize() in pii.MONTHS else full[:3]
        full = full.upper() if name.isupper() else full.lower() if name.islower() else full
        number = f"{new.day:02d}" if d.startswith("0") else str(new.day)
        return re.sub(r"[A-Za-z]+|\d+", lambda m: full if m[0].isalpha() else str(new.year) if len(m[0]) == 4 else number, v)

    def ssn(self, v):
        d = re.sub(r"\D", "", v)
        areas = [x for x in range(1, 900) if x != 666]
        a, b = self.feistel(areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999, "ssn")
        return fill(v, f"{areas[a // 99]:03d}{a % 99 + 1:02d}{b + 1:04d}")

    def phone(self, v):
        d = re.sub(r"\D", "", v)
        front, d = d[:-10], d[-10:]
        planned = lambda x: re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", x)
        if planned(d):
            a, b = self.feistel(int(d[:3]) - 200, int(d[3:]) - 2_000_000, 800, 8_000_000, "phone")
            return fill(v, f"{front}{a + 200}{b + 2_000_000}")
        d = self.digits(d, "phone")
        while planned(d):
            d = self.digits(d, "phone")
        return fill(v, front + d)

    def one_card(self, v):
        d = self.digits(re.sub(r"\D", "", v)[:-1], "card")
        return fill(v, d + next(c for c in "0123456789" if luhn(d + c)))

    def card(self, v):
        groups, signs = re.split("[ -]", v), [*re.findall("[ -]", v), ""]
        n = len(groups)
        usual = lambda i, k: re.fullmatch("4-4-4-4|4-6-[45]|1[3-9]", "-".join(str(len(g)) for g in groups[i : i + k]))
        good = lambda i, k: 13 <= len(d := "".join(groups[i : i + k])) <= 19 and luhn(d)
        large = lambda i, k: k <= 6 and i + k <= n and all(len(g) > 2 for g in groups[i : i + k])
        if sum(map(len, groups)) <= pii.SHORT_RUN:
            some = {(0, n)} | ({(1, n - 1), (0, n - 1), (1, n - 2)} if n > 2 else set()) | {(i, k) for i in range(n) for k in range(1, 7) if large(i, k)}
            ranked = sorted((0 if usual(i, k) else 1 if k == n else 2, 0 if usual(i, k) else -sum(map(len, groups[i : i + k])), i, k) for i, k in some if k > 0 and good(i, k))
            chosen = []
            for *_, i, k in ranked:
                if all(i + k <= j or j + m <= i for j, m in chosen):
                    chosen.append((i, k))
        else:
            chosen, i = [], 0
            while i < n:
                here = [(bool(usual(i, k)), k) for k in range(1, 7) if large(i, k) and good(i, k)]
                first, k = max(here, default=(False, 0))
                if k and (first or not any(usual(j, m) and good(j, m) for j in range(i + 1, i + k) for m in range(1, 7) if large(j, m))):
                    chosen.append((i, k))
                    i += k - 1
                i += 1
        out, i, starts = "", 0, dict(chosen)
        while i < n:
            k = starts.get(i, 1)
            text = "".join(g + s for g, s in zip(groups[i : i + k], signs[i : i + k]))
            last = signs[i + k - 1]
            out += (self.one_card(text[: len(text) - len(last)]) + last) if i in starts else text
            i += k
        return out, len(chosen)

    def text(self, t):
        if t is None:
            return None, 0
        total = 0

        def new(m):
            nonlocal total
            kind = m.lastgroup
            if kind == "card":
                out, n = self.card(m[0])
            else:
                out = getattr(self, {"secret": "secret_"}.get(kind, kind))(m[0])
                n = int(out != m[0])
            total += n
            return out

        return ANY.sub(new, t), total


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0


def fill(shape, digits):
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), shape)
