"""Pseudonyms in plain Python, value by value: what the SQL expressions are compared with."""

import hashlib
import re
from datetime import date, timedelta

from quern.llm.pii import ANY, PATTERNS

FIRST = date(1800, 1, 1)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class Brute:
    def __init__(self, key):
        self.key = key

    def feistel(self, left, right, a, b, tweak):
        for i in range(8):
            half, size = (right, a) if i % 2 == 0 else (left, b)
            turn = int(hashlib.sha256(f"{self.key}|{tweak}|{i}|{half}".encode()).hexdigest()[:14], 16) % size
            if i % 2 == 0:
                left = (left + turn) % a
            else:
                right = (right + turn) % b
        return left, right

    def string(self, s, alphabet, tweak):
        out, r = "", len(alphabet)
        for k, at in enumerate(range(0, len(s), 20)):
            part = s[at : at + 20]
            u = len(part) // 2
            v = len(part) - u
            value = lambda x: sum(alphabet.index(c) * r**i for i, c in enumerate(reversed(x)))  # noqa: B023, E731
            spell = lambda n, size: "".join(alphabet[n // r ** (size - j) % r] for j in range(1, size + 1))
            left, right = self.feistel(value(part[:u]), value(part[u:]), r**u, r**v, f"{tweak}/{k}/{len(part)}")
            out += spell(left, u) + spell(right, v)
        return out

    @staticmethod
    def refill(x, by, kind):
        it = iter(by)
        return "".join(next(it) if re.match(kind, c) else c for c in x)

    def masked(self, m, tweak):
        low = re.sub("[^a-z]", "", "".join(c.lower() for c in m if c.isascii() and c.isalpha()))
        letters = iter(self.string(low, "abcdefghijklmnopqrstuvwxyz", tweak))
        digits = iter(self.string(re.sub("[^0-9]", "", m), "0123456789", tweak + low))
        made = ""
        for c in m:
            if re.match("[A-Za-z]", c):
                new = next(letters)
                made += new.upper() if c.isupper() else new
            else:
                made += next(digits) if re.match("[0-9]", c) else c
        return made

    def email(self, x):
        local, domain = x.split("@")
        return self.masked(local, "email") + "@" + domain

    def secret(self, x):
        v = re.search("[A-Za-z0-9_+/-]+$", x)[0]
        if re.fullmatch("[0-9a-f]{16,}", v):
            new = self.string(v, "0123456789abcdef", "secret")
        elif re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            new = "".join(self.masked(v[i : i + 60], f"secret{i // 60}") for i in range(0, len(v), 60))
        else:
            return None
        return x[: len(x) - len(v)] + new

    def aws(self, x):
        return "AKIA" + self.string(x[4:], ALNUM, "key")

    def iban(self, x):
        q = x.replace(" ", "")
        mod = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if mod(q[4:] + q[:4]) != 1:
            return None
        account = self.refill(q[4:], self.string(re.sub("[^0-9]", "", q[4:]), "0123456789", "iban" + q[:2]), "[0-9]")
        return self.refill(x, f"{q[:2]}{98 - mod(account + q[:2] + '00'):02d}{account}", "[A-Z0-9]")

    def phone(self, x):
        q = re.sub("[^0-9]", "", x)
        if re.match("[+][2-9]", x):
            return self.refill(x, q[:2] + self.string(q[2:], "0123456789", "phone" + q[:2]), "[0-9]") if 8 <= len(q) <= 15 else None
        area, exchange, line = int(q[-10:-7]), int(q[-7:-4]), int(q[-4:])
        if not (x[0] in "+(" or area >= 200 and exchange >= 200):
            return None
        (low_a, many_a), (low_e, many_e) = ((200, 800) if v >= 200 else (0, 200) for v in (area, exchange))
        pair, line = self.feistel((area - low_a) * many_e + exchange - low_e, line, many_a * many_e, 10000, f"phone{str(area >= 200).lower()}{str(exchange >= 200).lower()}")
        return self.refill(x, q[:-10] + f"{low_a + pair // many_e:03d}{low_e + pair % many_e:03d}{line:04d}", "[0-9]")

    def card(self, x):
        q = re.sub("[^0-9]", "", x)
        luhn = lambda d: sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d)))
        if luhn(q) % 10:
            return None
        new = self.string(q[:-1], "0123456789", "card")
        return self.refill(x, new + str(-luhn(new + "0") % 10), "[0-9]")

    def ip(self, x):
        o = [int(v) for v in x.split(".")]
        if max(o) > 255:
            return None
        left, right = self.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"

    def ssn(self, x):
        area, group, serial = map(int, x.split("-"))
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        left, right = self.feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}"

    def date(self, x):
        marks = re.sub("[0-9]", "", x)
        turned = re.match("[0-9]{2}/", x) and x[:2] > "12"
        shape = "%Y-%m-%d" if x[4] == "-" else "%Y/%m/%d" if x[4] == "/" else "%d.%m.%Y" if "." in x else "%d/%m/%Y" if turned else "%m/%d/%Y"
        numbers = [int(v) for v in re.split("[-./]", x)]
        year, month, day = numbers if shape[1] == "Y" else numbers[::-1] if shape[1] == "d" else (numbers[2], numbers[0], numbers[1])
        try:
            n = (date(year, month, day) - FIRST).days
        except ValueError:
            return None
        if marks[0] != marks[1] or not 0 <= n <= 146096:
            return None
        while True:
            left, right = self.feistel(n // 773, n % 773, 189, 773, "date")
            n = left * 773 + right
            y = FIRST + timedelta(n)
            if not turned or y.day > 12:
                return {"%Y-%m-%d": f"{y.year}-{y.month:02d}-{y.day:02d}", "%Y/%m/%d": f"{y.year}/{y.month:02d}/{y.day:02d}", "%d.%m.%Y": f"{y.day:02d}.{y.month:02d}.{y.year}", "%d/%m/%Y": f"{y.day:02d}/{y.month:02d}/{y.year}", "%m/%d/%Y": f"{y.month:02d}/{y.day:02d}/{y.year}"}[shape]

    def text(self, text):
        """New text, number of finds, and their kinds."""
        kinds = []

        def one(m):
            for kind, pattern in PATTERNS.items():
                if re.fullmatch(pattern, m[0], re.A):
                    new = getattr(self, "aws" if kind == "key" else kind)(m[0])
                    if new is not None:
                        kinds.append(kind)
                        return new
            return m[0]

        if text is None:
            return None, 0, ""
        new = re.sub(ANY, one, text, flags=re.A)
        return new, len(kinds), ",".join(sorted(set(kinds)))
