"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field segments a site (a stretch of chunks with digits or @, and the words before it) into entities of bounded length
and single tokens outside. A whole candidate segment is scored by features of all of it (shape, digit count, checksum,
octets, cue words before it); boundaries and types are chosen jointly by dynamic programming. It is trained by the
likelihood of generated sites, whose rules stand in `example`, from a fixed seed.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import column_or_null

BASE = ("email", "ip", "card", "phone")
#: What the field knows besides: access keys, assigned secrets, national ids of 3-2-4 digits, bank accounts.
KINDS = (*BASE, "key", "secret", "national_id", "iban")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, which keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind; those that fail their check are dropped."""
    found = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            past = m.end()
            found.append(("email", start, past))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CUES = {"token": "secret", "secret": "secret", "password": "secret", "apikey": "secret", "key": "secret", "ssn": "id", "iban": "bank", "phone": "call", "tel": "call", "call": "call"}
MOST = 40  # tokens of an entity
WORDS = 10  # words of an entity
MARGIN = 3.0  # how much likelier, as a logarithm, an entity must be than what the field would say without it
LABELS = ("", *KINDS)
#: How accounts begin; groups of such a one may be letters only.
_ACCOUNT = re.compile("[A-Z]{2}[0-9]{2}(?![a-z])")
_GROUP = re.compile("[A-Z]{1,4}")
#: Words with a digit or @ in a row. Each word is looked at once, from its start, however long it is.
_MARKED = r"(?=[^\s0-9@]*+[0-9@])\S++"
_NUMBERED = re.compile(rf"(?<!\S){_MARKED}(?:(?<=(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}})(?: [A-Z0-9]{{1,4}}(?![A-Za-z0-9])){{2,8}}+\S*+)?(?: {_MARKED})*+")
#: Entities without a digit: access keys, quoted values of secrets, and of tokens and keys where they change case often.
_BARE = re.compile(
    r"(?<![A-Za-z0-9])(?P<key>(?:AKIA|ASIA)[A-Z]{16})(?![A-Za-z0-9])|(?<![A-Za-z])(?i:password|secret)[\"']?[^\S\n]*[:=][^\S\n]*(?P<q>[\"'])(?P<secret>[^\s\"'0-9@]{8,})(?P=q)"
    r"|(?<![A-Za-z])(?i:token|apikey|key)[\"']?[^\S\n]*[:=][^\S\n]*(?P<r>[\"'])(?P<token>(?=(?:[^\s\"']*?[a-z][A-Z]){3})[^\s\"'0-9@]{16,})(?P=r)"
)
_BARE_SIGNS = ("akia", "asia", "password", "secret", "token", "key")
#: Countries' account numbers after the check digits: a letters, n digits, c either.
ACCOUNTS = {"GB": "4a14n", "IE": "4a14n", "NL": "4a10n", "BG": "4a6n8c", "LV": "4a13c", "MT": "4a5n18c", "RO": "4a16c", "DE": "18n", "FR": "10n11c2n", "ES": "20n", "CH": "5n12c", "IT": "1a10n12c", "BE": "12n", "NO": "11n"}


_KINDS_OF_CHARACTER = {**dict.fromkeys(range(48, 58), "9"), **dict.fromkeys(range(65, 91), "A"), **dict.fromkeys(range(97, 123), "a")}
_LONGER = re.compile(r"([9aA])\1{2,}")


@lru_cache(maxsize=1 << 14)
def _shape(text: str) -> str:
    """Digits as 9 and letters as a or A, with longer runs marked by +; other characters as they are."""
    return _LONGER.sub(r"\1+", text.translate(_KINDS_OF_CHARACTER))


def _checked(account: str) -> bool:
    """Whether an account's check digits fit (modulo 97)."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _account_like(text: str, ends: bool) -> bool:
    """Whether groups of capitals in a text, or at its end, can be an account's."""
    return not ends and len(_DIGIT.findall(text)) >= 8 or re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,36}", text) is not None and _checked(text.replace(" ", ""))


def _bare(text: str) -> dict[int, int]:
    """Where the entities without a digit begin and end."""
    return {m.start(k): m.end(k) for m in _BARE.finditer(text) for k in ("key", "secret", "token") if m[k]} if _hints(text) else {}


def _hints(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _BARE_SIGNS)


def _segment_features(text: str, before: str, cue: str, after: str) -> list[str]:
    digits = _DIGIT.findall(text)
    n, count = len(text), len(digits)
    plain = text.replace(" ", "").replace("-", "")
    tag = ""  # what a check of the whole segment says goes into each of its features
    if plain.isdigit() and 13 <= count <= 19:
        tag = f"luhn{luhn(plain)}"
    elif text.count(".") == 3 and text.replace(".", "").isdigit() and all(text.split(".")):
        tag = f"octets{_octets(text)}"
    out = [f"n{min(n // 4, 12)}{tag}", f"d{min(count, 20)}{tag}", f"s{_shape(text)}{tag}", f"f{_shape(text[0])}{_shape(text[-1])}{tag}", f"b{_shape(before)}", f"a{_shape(after)}", f"cue{cue}", f"t{tag}"]
    if (at := text.find("@")) > 0:
        out.append(f"mail{'.' in text[at:]}{' ' in text}{before in ' ^'}")
    else:
        out.append("no mail")
    if n >= 16 and text.isalnum():
        out.append(f"run{text.isupper()}{bool(re.fullmatch('[0-9a-f]+', text))}{0 < count < n}{cue == 'secret'}")
    if text[0] == "+" and count == n - 1 - sum(text.count(c) for c in " ().-"):
        out.append(f"call{9 <= count <= 15}{text[-1].isdigit()}")
    if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,36}", text):
        out += ["bank", f"bank{_checked(text.replace(' ', ''))}"]
    if not count and "@" not in text:
        out.append(f"bare{bool(re.fullmatch('A[KS]IA[A-Z]{16}', text))}{cue == 'secret'}")
    return out


class Field:
    """Weights of segment features by label, and of label pairs."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.w = np.zeros((1 << 14, len(LABELS)))
        self.seen = np.zeros_like(self.w)  # squared steps so far: features that move often move less
        self.pair = np.zeros((len(LABELS), len(LABELS)))

    def _ids(self, names: list[str], grow: bool) -> list[int]:
        if grow:
            for x in names:
                if len(self.rows) < len(self.w):
                    self.rows.setdefault(x, len(self.rows))
        return [self.rows[x] for x in names if x in self.rows]

    def candidates(self, site: str, grow: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
        """Tokens of a site, and (first token, end token, features) of each candidate segment: single tokens, and up to
        MOST tokens that neither begin nor end with white space, with a digit or @ in each of their words. Short groups of
        capitals count as such words in what begins as an account, if its check digits fit or if 8 digits are in it and
        none of them is its end; entities without a digit are candidates as they are."""
        tokens, bare = [m.span() for m in _TOKEN.finditer(site)], _bare(site)
        out, cue = [], ""
        for i, (a, b) in enumerate(tokens):
            first = site[a]
            out.append((i, i + 1, self._ids(["o", f"o{_shape(first)}"], grow)))
            word = site[a:b].lower()
            before = site[a - 1] if a else "^"
            if a in bare:
                j = next(k for k in range(i, len(tokens)) if tokens[k][1] == bare[a]) + 1
                out.append((i, j, self._ids(_segment_features(site[a : bare[a]], before, cue, site[bare[a] : bare[a] + 1] or "$"), grow)))
                cue = _CUES.get(word, cue)
                continue
            if not (first.isalnum() or first == "+"):
                continue
            # a token inside of a run can't begin an entity
            if before.isalnum() or before in "_%":
                cue = _CUES.get(word, cue)
                continue
            marked, account, start, capitals = False, _ACCOUNT.match(site, a), a, False
            ats = pluses = words = 0
            for j in range(i + 1, min(len(tokens), i + MOST) + 1):
                last = site[tokens[j - 1][0] : tokens[j - 1][1]]
                if last.isspace():
                    if not marked:
                        break  # a word without a digit or @ is no part of an entity of several words
                    marked, start, words = False, tokens[j - 1][1], words + 1
                    if words == WORDS:
                        break
                    continue
                ats, pluses = ats + (last == "@"), pluses + (last == "+")
                if ats > 1 or pluses > 1:
                    break  # no entity holds two of them
                marked = marked or last[0].isdigit() or last == "@"
                ends = bool(account and start == tokens[j - 1][0] and _GROUP.fullmatch(last))
                marked, capitals = marked or ends, capitals or ends
                after = site[tokens[j][0]] if j < len(tokens) else "$"
                if capitals and not _account_like(site[a : tokens[j - 1][1]], ends):
                    continue
                if marked and (last[-1].isalnum()) and not after.isalnum():
                    out.append((i, j, self._ids(_segment_features(site[a : tokens[j - 1][1]], before, cue, after), grow)))
            cue = _CUES.get(word, cue)
        return tokens, out

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        s = np.array([self.w[f].sum(0) for _, _, f in segments])
        k = 0
        for k, (i, j, _) in enumerate(segments):
            single_outside = k == 0 or segments[k - 1][0] != i
            if single_outside:
                s[k, 1:] = -1e9  # the first of each start is the token outside of entities
            else:
                s[k, 0] = -1e9
            del j
        return s

    def best(self, site: str) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation: kind, start, end within the site."""
        tokens, segments = self.candidates(site)
        if len(segments) == len(tokens):
            return []
        s = self.scores(segments)
        s[:, 1:] -= MARGIN
        value = np.full((len(tokens) + 1, len(LABELS)), -np.inf)
        value[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (i, j, _) in enumerate(segments):
            reach = value[i][:, None] + self.pair
            came = reach.argmax(0)
            total = reach[came, np.arange(len(LABELS))] + s[k]
            for y in np.flatnonzero(total > np.maximum(value[j], -1e8)):
                value[j, y] = total[y]
                back[j, int(y)] = (k, int(came[y]))
        out, j, y = [], len(tokens), int(value[len(tokens)].argmax())
        while j:
            k, before = back[j, y]
            i = segments[k][0]
            if y:
                out.append((LABELS[y], tokens[i][0], tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def learn(self, site: str, entities: list[tuple[str, int, int]], rate: float) -> None:
        """A step up the log likelihood of a site's segmentation: expectations by forward and backward sums."""
        tokens, segments = self.candidates(site, grow=True)
        s, n = self.scores(segments), len(tokens)
        add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        ahead, behind = np.full((n + 1, len(LABELS)), -1e9), np.full((n + 1, len(LABELS)), -1e9)
        ahead[0, 0], behind[n] = 0, 0
        for k, (i, j, _) in enumerate(segments):
            ahead[j] = np.logaddexp(ahead[j], add(ahead[i][:, None] + self.pair, 0) + s[k])
        for k in range(len(segments) - 1, -1, -1):
            i, j, _ = segments[k]
            behind[i] = np.logaddexp(behind[i], add(self.pair + (s[k] + behind[j])[None, :], 1))
        total = add(ahead[n], 0)
        true = {(a, b): LABELS.index(kind) for kind, a, b in entities}
        spans = sorted(true)
        label, place = 0, 0
        for k, (i, j, f) in enumerate(segments):
            expected = np.exp(np.minimum(0, ahead[i][:, None] + self.pair + (s[k] + behind[j])[None, :] - total))
            a, b = tokens[i][0], tokens[j - 1][1]
            y = true.get((a, b)) if s[k, 0] < -1e8 else (0 if not any(p <= a < q for p, q in spans) else None)
            step = -expected.sum(0)
            self.pair -= 0.2 * rate * expected
            if y is not None:
                step[y] += 1
                if a >= place:
                    self.pair[label, y] += 0.2 * rate
                    label, place = y, b
            for x in f:
                self.seen[x] += step * step
                self.w[x] += rate * step / np.sqrt(self.seen[x] + 1e-8)


def example(draw: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A site: words, numbers that are nothing, and entities of all kinds, with their places."""
    word = lambda a=2, b=9: "".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randint(a, b)))
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = draw.choice("3456") + digits(draw.choice((13, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return body if draw.random() < 0.5 else draw.choice("- ").join(body[k : k + 4] for k in range(0, len(body), 4))

    def not_card() -> str:
        body = digits(draw.choice((13, 14, 15, 15, 15)))
        return body + draw.choice([c for c in "0123456789" if not luhn(body + c)])

    def coded() -> str:
        """Several short words with digits in them."""
        return " ".join(f"{word(1, 3)}{digits(draw.randint(1, 5))}{word(0, 2)}{digits(draw.randint(0, 2))}" for _ in range(draw.randint(1, 8)))

    def account() -> str:
        country, letters = draw.choice(sorted(ACCOUNTS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        own = "".join(draw.choice({"a": letters, "n": "0123456789", "c": "0123456789" + letters}[k]) for n, k in re.findall("([0-9]+)([anc])", ACCOUNTS[country]) for _ in range(int(n)))
        whole = next(f"{country}{k:02d}{own}" for k in range(2, 99) if _checked(f"{country}{k:02d}{own}"))
        return whole if draw.random() < 0.4 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    def unnumbered() -> tuple[str, str, str]:
        """A secret without a digit."""
        if draw.random() < 0.5:
            return draw.choice(['secret = "', 'password: "', 'password = "']), "-".join(word(3, 7) for _ in range(draw.randint(2, 4))) if draw.random() < 0.5 else word(8, 16), '"'
        return draw.choice(['token = "', 'secret = "', 'password: "', 'key = "']), "aBcDeF" + "".join(draw.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(draw.randint(10, 34))), '"'

    def make(kind: str) -> tuple[str, str, str]:
        if kind == "email":
            return "", f"{word()}{draw.choice(['', '.', '_', '-'])}{draw.choice(['', digits(2), word()])}".strip("._-") + f"@{word()}{digits(draw.randint(0, 1))}.{draw.choice(['com', 'org', 'example.com', 'co.uk', 'net'])}", ""
        if kind == "ip":
            return "", ".".join(str(draw.randint(0, 255)) for _ in range(4)), ""
        if kind == "card":
            return "", card(), ""
        if kind == "phone":
            return draw.choice(["", "", "phone ", "tel: "]), draw.choice([f"+{draw.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{draw.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(11)}", f"+{draw.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}"]), ""
        if kind == "key" and draw.random() < 0.3:
            return "", draw.choice(["AKIA", "ASIA"]) + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16)), ""
        if kind == "secret" and draw.random() < 0.3:
            return unnumbered()
        if kind == "key":
            return "", draw.choice(["AKIA", "ASIA"]) + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + draw.choice("234567"), ""
        if kind == "secret":
            value = "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((32, 40, 40, 64)))) if draw.random() < 0.8 else "".join(draw.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(29)) + "7a4"
            return draw.choice(['token = "', 'secret = "', 'password: "', 'key = "']), value, '"'
        if kind == "national_id":
            return draw.choice(["", "ssn "]), f"{digits(3)}-{digits(2)}-{digits(4)}", ""
        return draw.choice(["", "iban "]), draw.choice(["DE", "FR", "ES", "GB"]) + digits(2) + draw.choice([digits(18), " ".join(digits(4) for _ in range(4))]) if draw.random() < 0.3 else account(), ""

    def nothing() -> str:
        return draw.choice([digits(draw.randint(1, 4)), digits(draw.randint(5, 12)), f"{draw.randint(1, 12)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{word()}{digits(1)}", f"{digits(3)}.{digits(3)}.{draw.randint(256, 999)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", not_card(), not_card(), f"@{word()}", f"{digits(3)}-{digits(4)}", word() + digits(3) + word(), f"Version {digits(1)}.0", f"({digits(4)})", coded(), coded()])

    text, found = "", []
    for _ in range(draw.choice((1, 1, 2, 3))):
        if draw.random() < 0.4:
            text += word() + draw.choice([" ", ". ", ", "])
        if draw.random() < 0.55:
            kind = draw.choice(KINDS)
            before, value, after = make(kind)
            found.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after
        else:
            text += nothing()
        text += draw.choice(["", "", ",", "."]) + " "
    return text.rstrip(" "), found


@lru_cache(maxsize=2)
def trained(examples: int = 900, rounds: int = 4, seed: int = 5) -> Field:
    field, draw = Field(), random.Random(seed)
    sites = [example(draw) for _ in range(examples)]
    for k in range(rounds):
        for site, entities in sites:
            field.learn(site, entities, 0.5 / (1 + k))
    return field


def sites(text: str) -> Iterator[tuple[int, str]]:
    """Stretches of a text where an entity could be."""
    found = [m.span() for m in _NUMBERED.finditer(text)] if _DIGIT.search(text) or "@" in text else []
    if _hints(text):
        more = [m.span() for m in _BARE.finditer(text)]
        firsts = [a for a, _ in found]
        found = sorted([*found, *((a, b) for a, b in more if not ((k := bisect_right(firsts, a)) and b <= found[k - 1][1]))])
    for a, b in found:
        start = max(text.rfind("\n", 0, a) + 1, a - 24)
        while start < a and start and text[start - 1].isalnum():
            start += 1
        yield start, text[start:b]


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the field adds: none that overlaps another."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for start, site in sites(text):
        for kind, a, b in field.best(site):
            a, b = a + start, b + start
            if not any(p < b and a < q for p, q in taken[max(0, _place(taken, a) - 4) : _place(taken, b) + 1]):
                added.append((kind, a, b))
                taken.insert(_place(taken, a), (a, b))
    return base, added


def _place(spans: list[tuple[int, int]], at: int) -> int:
    return bisect_left(spans, (at, -1))


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field | None = None, redact: bool = False) -> DataFrame:
    """All columns of docs (doc_id, text and others), with n_email, n_ip, n_card, n_phone, base_sha256 and spans; with
    redact, text has <KIND> in place of each span and n_chars is the new text's.

    base_sha256: of the base spans (kind:start:end in code points, end exclusive, by kind, then start). spans: the same of
    all spans. Null texts stay null and have no spans, as empty ones; repeated rows give alike rows; columns with these
    names are replaced; an empty table gives no rows.
    """
    field = field or trained()
    made = {"n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows, texts = batch.schema.names, [], []
            k = names.index("text")
            for text in batch.column(k).to_pylist():
                base, added = all_spans(text, field) if text else ([], [])
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(b) for b in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
                if redact:
                    texts.append(redacted(text, base + added) if text and (base or added) else text)
            columns = list(batch.columns)
            if redact:
                columns[k] = pa.array(texts, batch.schema.field(k).type)
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            columns += [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(made), made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *made])

    docs = docs.drop(*made).withColumn("text", column_or_null(docs, "text", "string"))
    if redact and "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
