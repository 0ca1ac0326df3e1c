"""Personal data: fixed patterns, and a semi-Markov conditional random field for forms that they miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import chunks, map_columns

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens: the bound of the dynamic program.
LONGEST = 20
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and non-overlapping for each kind, by kind, then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # A match starts where the run of local characters before an @ starts, or where the match before ended.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, start) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out.extend(("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out.extend(("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    return out


# --- The semi-Markov conditional random field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: A whole address with an at sign and dots in some form, and its part from the sign on.
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+| \. )"
_AHEAD = rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+(?:@|\s?[\[({{<]\s?at\s?[\])}}>]\s?|\s+at\s+| @ |@ | @){_AHEAD}", re.I)
_FROM_SIGN = re.compile(rf"(?:@|at)\s?[\])}}>]?\s*{_AHEAD}", re.I)
_QUAD = r"[0-9]{1,3}(?:\s?[.]\s?[0-9]{1,3}){3}"
_CUES = {"phone": ("phone", "tel", "call", "mobile", "fax", "telephone", "tfno", "telefon", "téléphone"), "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"), "email": ("email", "mail", "contact", "e"), "ip": ("ip", "host", "server", "address")}
_LUHN_LENGTHS = range(13, 20)


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int


def tokenize(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    return [Token(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def segment_features(text: str, tokens: list[Token], a: int, b: int) -> list[int]:
    """Features of the whole candidate tokens[a:b]: 0/1 for each entry of a fixed list."""
    raw = text[tokens[a].start : tokens[b - 1].end]
    words = [t.text for t in tokens[a:b]]
    low = [w.lower() for w in words]
    digits = _digits(raw)
    groups = [w for w in words if w.isascii() and w.isdigit()]
    n = len(digits)
    only = not re.search(r"[^0-9 ().+/\-–]", raw)
    seps = set(re.sub(r"[0-9]", "", raw))
    at = sum(w in ("@", "at") for w in low)
    dots = sum(w in (".", "dot") for w in low)
    ends_word = words[-1].isalnum() and not words[-1].isdigit() and 2 <= len(words[-1]) <= 6 and words[-1].isascii()
    address = bool(_ADDRESS.fullmatch(raw))
    before = tokens[a - 1].text.lower() if a else ""
    before2 = tokens[a - 2].text.lower() if a > 1 else ""
    glued = (a > 0 and tokens[a - 1].end == tokens[a].start) + (b < len(tokens) and tokens[b - 1].end == tokens[b].start and tokens[b].text not in ".,;:!?)")
    number_before = a > 0 and tokens[a - 1].text[-1].isdigit() and tokens[a].start - tokens[a - 1].end <= 1
    number_after = b < len(tokens) and tokens[b].text[0].isdigit() and tokens[b].start - tokens[b - 1].end <= 1
    quad = only and bool(re.fullmatch(_QUAD, raw)) and all(int(g) < 256 for g in groups)
    return [
        1,
        only and 7 <= n <= 9,
        only and 10 <= n <= 12,
        only and 13 <= n <= 15,
        only and 16 <= n <= 19,
        only and n > 19,
        n < 7,
        not only,
        only and len(groups) == 1,
        only and len(groups) in (2, 3, 4, 5),
        only and bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .\-–]?\s?[0-9]{3}[ .\-–][0-9]{4}", raw)),
        only and bool(re.fullmatch(r"\+?[0-9]{1,3}[ .-]\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", raw)),
        only and bool(re.fullmatch(r"00[0-9]{1,3}[ .\-()0-9]+", raw)) and 9 <= n <= 15,
        only and bool(re.fullmatch(r"[0-9]{4}([ .\-/–])(?:[0-9]{4}\1){2}[0-9]{1,7}", raw)) and n >= 13,
        only and n in _LUHN_LENGTHS and luhn(digits),
        only and n in _LUHN_LENGTHS and not luhn(digits),
        bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", raw)),
        "/" in seps,
        len(seps - {"(", ")", " ", "+"}) > 1,
        raw.count("(") != raw.count(")"),
        address,
        at == 1 and dots >= 1,
        at == 0,
        at > 1,
        ends_word,
        quad,
        glued > 0,
        before in _CUES["phone"] or before in (":", ".") and before2 in _CUES["phone"],
        before in _CUES["card"] or before == ":" and before2 in _CUES["card"],
        before in _CUES["email"] or before == ":" and before2 in _CUES["email"],
        before in _CUES["ip"] or before == ":" and before2 in _CUES["ip"],
        not raw[0].isalnum() and raw[0] not in "(+",
        not raw[-1].isalnum(),
        number_before,
        number_after,
        only and raw[0] == "+",
    ]


def candidates(text: str, tokens: list[Token]) -> list[tuple[int, int]]:
    """Token ranges that may be entities: at most LONGEST tokens, with seven digits or an at sign in some form, or four
    short groups of digits with dots between them."""
    found = []
    digits = np.concatenate([[0], np.cumsum([len(_digits(t.text)) if t.text.isascii() else 0 for t in tokens])]).astype(int)
    signs = np.concatenate([[0], np.cumsum([t.text.lower() in ("@", "at") for t in tokens])]).astype(int)
    quad = lambda a, b: tokens[a + 1].text == "." and re.fullmatch(_QUAD, text[tokens[a].start : tokens[b - 1].end])
    for a in range(len(tokens)):
        for b in range(a + 1, min(len(tokens), a + LONGEST) + 1):
            if digits[b] - digits[a] >= 7 or signs[b] > signs[a] and b - a >= 4 or b - a == 7 and quad(a, b):
                found.append((a, b))
    return found


def viterbi(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best way to cut n tokens into entities (a, b, type) and single other tokens (score 0)."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for i, (_, b) in enumerate(segments):
        by_end.setdefault(b, []).append(i)
    for e in range(1, n + 1):
        best[e] = best[e - 1]
        for i in by_end.get(e, ()):
            k = int(np.argmax(scores[i]))
            if best[segments[i][0]] + scores[i, k] > best[e]:
                best[e], back[e] = best[segments[i][0]] + scores[i, k], (i, k)
    out, e = [], n
    while e:
        if back[e] is None:
            e -= 1
        else:
            i, k = back[e]
            out.append((*segments[i], k))
            e = segments[i][0]
    return out[::-1]


def marginals(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of each segment and type, and the log of the partition sum, by forward and backward sums."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    best = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(segments):
        by_end.setdefault(b, []).append(i)
        by_start.setdefault(a, []).append(i)
    starts, ends = (np.array([s[k] for s in segments], int) for k in (0, 1))
    for e in range(1, n + 1):
        mine = by_end.get(e, [])
        forward[e] = np.logaddexp.reduce(np.concatenate([[forward[e - 1]], forward[starts[mine]] + best[mine]]) if mine else [forward[e - 1]])
    for s in range(n - 1, -1, -1):
        mine = by_start.get(s, [])
        backward[s] = np.logaddexp.reduce(np.concatenate([[backward[s + 1]], backward[ends[mine]] + best[mine]]) if mine else [backward[s + 1]])
    return np.exp(forward[starts][:, None] + scores + backward[ends][:, None] - forward[n]) if len(segments) else scores, float(forward[n])


def examples(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with entities in forms that the patterns miss, and with numbers that are none."""
    r = random.Random(seed)
    syllables = ("ba", "tor", "lin", "mes", "ka", "du", "ren", "so", "vi", "per", "ust", "ola")
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    number = lambda k: "".join(r.choices("0123456789", k=k))

    def card() -> str:
        body = "4" + number(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice((".", "/", " . ", "-", "–")).join(full[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        at, dot = r.choice(((" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@ ", ".")))
        forms = {
            "email": f"{word()}{r.choice(('', '.' + word(), number(2)))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}",
            "phone": r.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"1 ({number(3)}) {number(3)}-{number(4)}", f"1-{number(3)}-{number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(3)} {number(3)}", f"+1 ({number(3)}) {number(3)}-{number(4)}")),
            "card": card(),
            "ip": " . ".join(str(r.randint(1, 255)) for _ in range(4)),
        }
        kind = r.choice(("email", "phone", "card", "phone", "email", "ip"))
        return kind, forms[kind]

    def other() -> str:
        return r.choice((number(r.randint(7, 24)), f"{r.randint(1900, 2099)}-{number(2)}-{number(2)}", f"{number(4)}/{number(4)}", f"{word()} at {word()} at {word()}", f"{number(3)},{number(3)},{number(3)}", f"{number(9)}{word()}", f"{number(2)} {number(2)} {number(2)} {number(2)}", f"{number(4)} {number(4)} {number(4)} {number(3)}", " ".join(number(r.randint(1, 5)) for _ in range(6)), f"@{word()}", f"{word()} @ {word()}", f"{number(1)}.{number(9)}", f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", f"FR{number(2)} {number(4)} {number(4)} {number(3)}"))

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(1, 3)):
            kind, piece = entity() if r.random() < 0.5 else ("", other())
            cue = r.choice(_CUES[kind]) + r.choice((" ", ": ")) if kind and r.random() < 0.3 else ""
            text += r.choice((" ", ", ", ". ")) + cue
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
            if kind == "phone" and r.random() < 0.3:  # a second entity right behind
                quad = ".".join(str(r.randint(1, 255)) for _ in range(4))
                text += " " + quad
                spans.append(("ip", len(text) - len(quad), len(text)))
            text += r.choice((" ", ", ", ". ")) + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, spans))
    return out


def short_quads(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with spaced IPs of fewer than seven digits, which `examples` has hardly any of, and with as many
    dotted numbers that are none, one part being over 255."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        parts = [r.randint(0, 9) if r.random() < 0.6 else r.randint(10, 99) for _ in range(4)]
        if i % 2:
            parts = [*parts[:3], r.randint(256, 999)]
        elif sum(len(str(x)) for x in parts) > 6:
            parts[0] %= 10
            parts[1] %= 10
        piece = " . ".join(map(str, parts))
        before = r.choice(("lin ", "ka, ", "ren. ", f"vi {r.choice(_CUES['ip'])} ", f"so {r.choice(_CUES['ip'])}: "))
        out.append((before + piece + r.choice((" ", ", ", ". ")) + "ola du", [] if i % 2 else [("ip", len(before), len(before) + len(piece))]))
    return out


def _excess(w: np.ndarray) -> np.ndarray:
    """For each kind the largest score that a candidate can have which is neither a written number nor a whole address: what
    such candidates always have, and the largest sum that their other features could add."""
    fixed, never, sign = (0, 7), (*range(1, 6), *range(8, 17), 20, 25, 35), (21, 22, 23)
    free = [i for i in range(w.shape[1]) if i not in (*fixed, *never, *sign)]
    return w[:, fixed].sum(1) + np.maximum(w[:, free], 0).sum(1) + np.maximum(w[:, sign].max(1), 0)


def train(n_examples: int = 240, steps: int = 40, l2: float = 0.02, rate: float = 0.5) -> np.ndarray:
    """The weights (kind by feature) that maximise the penalised likelihood of the made-up examples, by Adagrad steps over
    all of them, among those with which only written numbers and whole addresses can score above 0. Deterministic; a few seconds of work on the driver; nothing of the corpus is read."""
    data = []
    for text, spans in examples(n_examples) + short_quads(n_examples // 8):
        tokens = tokenize(text)
        segments = candidates(text, tokens)
        where = {(tokens[a].start, tokens[b - 1].end): i for i, (a, b) in enumerate(segments)}
        if lost := [text[s:e] for _, s, e in spans if (s, e) not in where]:
            raise ValueError(f"no candidates: {lost}")
        gold = [(where[(s, e)], KINDS.index(k)) for k, s, e in spans]
        if segments:
            data.append((len(tokens), segments, np.array([segment_features(text, tokens, a, b) for a, b in segments], float), gold))
    w = np.zeros((len(KINDS), data[0][2].shape[1]))
    w[:, 0] = -2
    seen = np.full_like(w, 1e-3)
    for _ in range(steps):
        g = l2 * len(data) / 100 * w
        for n, segments, x, gold in data:
            p, _ = marginals(n, segments, x @ w.T)
            for i, k in gold:
                p[i, k] -= 1
            g += p.T @ x
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        w[:, 7] -= np.maximum(0, _excess(w) + 1e-6)
    return w


class Tokens:
    """The tokens of several texts, laid end to end with a line break between two: numpy arrays instead of objects.

    start, end: where each token is; text: the number of its text; digits: its ASCII digits (0 if it has other than ASCII
    characters); sign: whether it is an at sign or the word for it; number: whether it may stand in a written number.
    """

    def __init__(self, texts: list[str]) -> None:
        self.joined = "\n".join(texts)
        self.begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[points]
        word, one = kind == 1, kind == 2
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        self.start = np.flatnonzero(one | word & ~before)
        self.end = np.flatnonzero(one | word & ~after) + 1
        digit = (points >= 48) & (points <= 57)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        n_digits, n_other = sums(digit), sums(points >= 128)
        size = self.end - self.start
        own = n_digits[self.end] - n_digits[self.start]
        self.digits = np.where(n_other[self.end] > n_other[self.start], 0, own)
        first = points[self.start] if len(self.start) else points[:0]
        lower = np.where(first < 128, first | 32, first)
        second = points[np.minimum(self.start + 1, max(0, len(points) - 1))] | 32 if len(points) else points[:0]
        self.sign = (size == 1) & (first == 64) | (size == 2) & (lower == 97) & (second == 116)
        self.number = (self.digits == size) | (size == 1) & np.isin(first, [ord(c) for c in "().+/-\u2013"])
        gap = np.maximum(0, self.start[1:] - self.end[:-1])
        spaces = sums(points == 32)
        self.linked = np.concatenate([[False], spaces[self.start[1:]] - spaces[self.end[:-1]] == gap])  # by blanks alone
        self.text = np.searchsorted(self.begin, self.start, "right") - 1


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 part of a word, 2 a token by itself - the classes that _TOKEN tells apart."""
    return np.array([1 if c.isalnum() else 0 if c.isspace() else 2 for c in map(chr, range(0x110000))], np.uint8)


def field_spans_of(texts: list[str], bases: list[list[Span]], w: np.ndarray) -> list[list[Span]]:
    """For each text the spans that the random field adds: over the whole text, the jointly best boundaries and kinds of
    entities that do not touch a base span.

    Every candidate of the field counts. Those that cannot score above 0 (see _excess) are not looked at. As tokens outside
    entities score 0, a candidate that does not score above 0 is in no best cut, and groups of others that overlap are cut
    each by itself: the result is that of one dynamic program over all tokens and candidates.
    """
    out: list[list[Span]] = [[] for _ in texts]
    t = Tokens(texts)
    n = len(t.start)
    if not n:
        return out
    total = np.concatenate([[0], np.cumsum(t.digits)])
    signs = np.concatenate([[0], np.cumsum(t.sign)])
    few = bool((_excess(w) <= 0).all())
    ranges: set[tuple[int, int]] = set()
    # Written numbers: runs of tokens that are digits or separators, with blanks between them at most.
    joins = t.number & np.concatenate([[False], t.number[:-1]]) & t.linked & np.concatenate([[False], t.text[1:] == t.text[:-1]])
    heads = np.flatnonzero(t.number & ~joins)
    tails = np.flatnonzero(t.number & ~np.concatenate([joins[1:], [False]])) + 1
    some = total[tails] - total[heads] >= 4
    heads, tails = heads[some], tails[some]
    size = tails - heads
    member = np.repeat(heads - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))  # all their tokens
    end = np.repeat(tails, size)
    codes = []  # a candidate as one number: a * 64 + length
    for length in range(1, LONGEST + 1):
        x = member[member + length <= end]
        enough = total[x + length] - total[x] >= 7
        if length == 7:
            four = np.flatnonzero(~enough & (total[x + length] - total[x] >= 4))
            enough[four] = [_is_quad(t, k) for k in x[four].tolist()]
        codes.append(x[enough] * 64 + length)
    if few:
        for k in np.flatnonzero(t.sign).tolist():
            if _FROM_SIGN.match(t.joined, t.start[k], int(t.begin[t.text[k] + 1]) - 1):
                for a in range(max(0, k - LONGEST + 1), k):
                    for b in range(k + 2, min(n, a + LONGEST) + 1):
                        if b - a >= 4 and t.text[a] == t.text[b - 1] and _ADDRESS.fullmatch(t.joined, t.start[a], t.end[b - 1]):
                            ranges.add((a, b))
    else:
        for length in range(1, LONGEST + 1):
            a = np.arange(n - length + 1)
            b = a + length
            found = (total[b] - total[a] >= 7) | (signs[b] > signs[a]) & (length >= 4)
            if length == 7:
                found |= np.array([four and _is_quad(t, x) for x, four in enumerate((total[b] - total[a] >= 4).tolist())], bool)
            ranges.update((x, x + length) for x in np.flatnonzero(found & (t.text[a] == t.text[b - 1])).tolist())
    codes.append(np.array([x * 64 + y - x for x, y in ranges], np.int64))
    found = np.unique(np.concatenate(codes).astype(np.int64))
    a, b = found >> 6, (found >> 6) + (found & 63)
    cover = {i: sorted((s, e) for _, s, e in base) for i, base in enumerate(bases) if base}
    if cover:
        held = np.isin(t.text[a], list(cover))
        for i in np.flatnonzero(held).tolist():
            at = int(t.begin[t.text[a[i]]])
            held[i] = any(s < t.end[b[i] - 1] - at and e > t.start[a[i]] - at for s, e in cover[int(t.text[a[i]])])
        a, b = a[~held], b[~held]
    kept = _worth(t, texts, a, b, w)
    group: list[tuple[int, int, int, float]] = []
    reach = 0
    for a, b, kind, score in [*kept, (n + 1, n + 1, 0, 0.0)]:
        if group and a >= reach:
            _cut(t, group, out)
            group, reach = [], 0
        group.append((a, b, kind, score))
        reach = max(reach, b)
    return [sorted(set(x), key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for x in out]


def _is_quad(t: Tokens, a: int) -> bool:
    return t.joined[t.start[a + 1]] == "." and bool(re.fullmatch(_QUAD, t.joined[t.start[a] : t.end[a + 6]]))


_ZEROS = str.maketrans("123456789", "000000000")
_CONTEXT = (26, 27, 28, 29, 30, 33, 34)  # what lies around a candidate: glued, the cues of each kind, a number before or behind


@functools.lru_cache(1 << 14)
def _own_features(shape: str, checked: bool, small: bool, start: str) -> tuple[int, ...]:
    """The features of a written number that its form decides, its digits being zeros in shape; whether its check digit is right
    and all its groups are under 256 is told, and how it starts: like a year (20), with two zeros (00) or else (10). Those of
    its surroundings are 0."""
    digits = _written(shape, checked, small, start)
    tokens = tokenize(digits)
    features = segment_features(digits, tokens, 0, len(tokens))
    return tuple(int(x) for x in features)


def _written(shape: str, checked: bool, small: bool, start: str) -> str:
    """A number of this shape whose check digit, groups and start are as told, where they matter."""
    n = shape.count("0")
    out = list(shape)
    at = [i for i, c in enumerate(shape) if c == "0"]
    out[at[0]] = start[0]
    if not small:
        for m in [*re.finditer("0{3}", shape)][-1:]:
            out[m.start()] = "9"
    if n in _LUHN_LENGTHS and luhn(_digits("".join(out))) != checked:
        for i in reversed(at):
            held = out[i]
            if i in at[:2] or (not small and held == "9"):
                continue
            out[i] = next((c for c in "0123456789" if luhn(_digits("".join([*out[:i], c, *out[i + 1 :]]))) == checked), held)
            break
    return "".join(out)


def _worth(t: Tokens, texts: list[str], a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(a, b, kind, score) of the candidates tokens[a:b] whose best kind scores above 0, in their order.

    Written numbers go through arrays: what a number's own form contributes is looked up by its shape (its digits as zeros),
    the check digit comes from running sums, and its surroundings are told for all tokens at once. Other candidates are few
    and are looked at one by one.
    """
    if not len(a):
        return []
    written, linked = (np.concatenate([[0], np.cumsum(x)]) for x in (t.number, t.linked))
    plain = (written[b] - written[a] == b - a) & (linked[b] - linked[a + 1] == b - a - 1)
    best = np.full(len(a), -np.inf)
    kind = np.zeros(len(a), int)
    for i in np.flatnonzero(~plain).tolist():
        k, at, low, high = _around(t, int(a[i]), int(b[i]))
        tokens = [Token(t.joined[s:e], s - at, e - at) for s, e in zip(t.start[low:high].tolist(), t.end[low:high].tolist(), strict=True)]
        scores = np.array(segment_features(texts[k], tokens, int(a[i]) - low, int(b[i]) - low), float) @ w.T
        kind[i], best[i] = int(np.argmax(scores)), scores.max()
    some = np.flatnonzero(plain)
    if len(some):
        scores = _number_scores(t, a[some], b[some], w)
        kind[some], best[some] = scores.argmax(1), scores.max(1)
    return [(int(a[i]), int(b[i]), int(kind[i]), float(best[i])) for i in np.flatnonzero(best > 0)]


def _around(t: Tokens, first: int, last: int) -> tuple[int, int, int, int]:
    """The text of tokens[first:last], where it begins, and the range of tokens that their features can depend on."""
    k = int(t.text[first])
    low, high = max(0, first - 2), min(len(t.start), last + 1)
    while t.text[low] < k:
        low += 1
    while t.text[high - 1] > k:
        high -= 1
    return k, int(t.begin[k]), low, high


def _number_scores(t: Tokens, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The scores (by kind) of written numbers tokens[a:b]."""
    points = np.frombuffer(t.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = np.flatnonzero((points >= 48) & (points <= 57))
    value = (points[where] - 48).astype(np.int64)
    twice = 2 * value - 9 * (value > 4)
    odd = np.arange(len(value)) % 2
    sums = [np.concatenate([[0], np.cumsum(np.where(odd == p, twice, value))]) for p in (0, 1)]  # p: the parity that is doubled
    i, j = np.searchsorted(where, t.start[a]), np.searchsorted(where, t.end[b - 1])
    total = np.where(j % 2 == 0, sums[0][j] - sums[0][i], sums[1][j] - sums[1][i])  # the last digit is not doubled
    n = j - i
    checked = (n >= _LUHN_LENGTHS.start) & (n < _LUHN_LENGTHS.stop) & (total % 10 == 0)
    large = np.zeros(len(t.start), np.int64)
    for k in np.flatnonzero(t.number & (t.digits == 3)).tolist():  # longer groups are none of an address anyway
        large[k] = int(t.joined[t.start[k] : t.end[k]]) > 255
    large = np.concatenate([[0], np.cumsum(large)])
    small = large[b] == large[a]
    zeros = t.joined.translate(_ZEROS)
    groups = np.concatenate([[0], np.cumsum(t.digits > 0)])
    found: dict[tuple, int] = {}
    forms: list[tuple[str, bool, bool, str]] = []
    own = np.empty(len(a), np.int64)
    columns = (t.start[a], t.end[b - 1], checked, small, n, np.minimum(groups[b] - groups[a], 6))
    for x, (s, e, c, q, digits, g) in enumerate(zip(*(v.tolist() for v in columns), strict=True)):
        shape = zeros[s:e]
        if digits > 19:  # longer than any form: all that counts is the number of groups and what stands between and around them
            key = (g, frozenset(shape), shape.count("(") == shape.count(")"), shape[0], shape[-1])
            form = (shape, False, True, "10")
        else:
            # a year matters where the form is that of a date, small groups where it has four
            head = t.joined[s : s + 2]
            start = "00" if head == "00" else "20" if head in ("19", "20") and len(shape) <= 10 else "10"
            key = form = (shape, c, q or shape.count(".") != 3, start)
        own[x] = found.setdefault(key, len(forms))
        if own[x] == len(forms):
            forms.append(form)
    static = np.array([_own_features(*form) for form in forms], float) @ w.T
    return static[own] + _context(t, a, b) @ w[:, _CONTEXT].T


def _context(t: Tokens, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The features _CONTEXT of written numbers tokens[a:b]; each depends on a few tokens before a or behind b."""
    word = lambda k: t.joined[t.start[k] : t.end[k]].lower()
    heads, ha = np.unique(a, return_inverse=True)
    tails, hb = np.unique(b, return_inverse=True)
    before = np.zeros((len(heads), 6), bool)  # glued, cues of phone, card, email, ip, number
    for i, k in enumerate(heads.tolist()):
        if not k or t.text[k - 1] != t.text[k]:
            continue
        one = word(k - 1)
        two = word(k - 2) if k > 1 and t.text[k - 2] == t.text[k] else ""
        before[i] = (
            t.end[k - 1] == t.start[k], one in _CUES["phone"] or one in (":", ".") and two in _CUES["phone"], one in _CUES["card"] or one == ":" and two in _CUES["card"],
            one in _CUES["email"] or one == ":" and two in _CUES["email"], one in _CUES["ip"] or one == ":" and two in _CUES["ip"],
            t.joined[t.end[k - 1] - 1].isdigit() and t.start[k] - t.end[k - 1] <= 1,
        )
    behind = np.zeros((len(tails), 2), bool)  # glued, number
    for i, k in enumerate(tails.tolist()):
        if k < len(t.start) and t.text[k] == t.text[k - 1]:
            one = t.joined[t.start[k] : t.end[k]]
            behind[i] = t.end[k - 1] == t.start[k] and one not in ".,;:!?)", one[0].isdigit() and t.start[k] - t.end[k - 1] <= 1
    left, right = before[ha], behind[hb]
    return np.column_stack([left[:, 0] | right[:, 0], left[:, 1:5], left[:, 5], right[:, 1]]).astype(float)


def _cut(t: Tokens, group: list[tuple[int, int, int, float]], out: list[list[Span]]) -> None:
    """Adds the entities of the best cut of the tokens of a group of candidates, which are in order."""
    first = group[0][0]
    k = int(t.text[first])
    at = int(t.begin[k])
    segments = [(a - first, b - first) for a, b, _, _ in group]
    scores = np.full((len(group), len(KINDS)), -np.inf)
    for i, (_, _, kind, score) in enumerate(group):
        scores[i, kind] = score
    for a, b, kind in viterbi(max(y for _, y in segments), segments, scores):
        out[k].append((KINDS[kind], int(t.start[a + first]) - at, int(t.end[b + first - 1]) - at))


def field_spans(text: str, base: list[Span], w: np.ndarray) -> list[Span]:
    """The spans that the random field adds to one text."""
    return field_spans_of([text], [base], w)[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of the patterns), base_sha256 (of the patterns' spans) and spans (all
    spans, kind:start:end by kind and start, comma-joined; code points, end exclusive).

    Whole texts are searched; null counts as empty: no spans, the digest of the empty text. Extra columns stay, columns
    named like a result are replaced.
    """
    w = train() if w is None else w

    def factory():
        def run(text):
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for _, part in chunks([t or "" for t in text.to_pylist()]):
                bases = [base_spans(t) for t in part]
                for base, more in zip(bases, field_spans_of(part, bases, w), strict=True):
                    for column, kind in zip(counts, KINDS, strict=True):
                        column.append(sum(k == kind for k, _, _ in base))
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
            return [pa.array(c, pa.int64()) for c in counts] + [pa.array(digest, pa.string()), pa.array(spans, pa.string())]

        return run

    return map_columns(docs, ["text"], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", factory)


def mask(docs: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become one, named by the first.
    A null text stays null; no row is dropped."""
    w = train() if w is None else w

    def redact(t: str, spans: list[Span]) -> str:
        out, end = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= end:
                out += [t[end:s], f"[{kind.upper()}]"]
            end = max(end, e)
        return "".join(out) + t[end:]

    def factory():
        def run(text):
            out = []
            for _, part in chunks([t or "" for t in text.to_pylist()]):
                bases = [base_spans(t) for t in part]
                out += [redact(t, b + f) for t, b, f in zip(part, bases, field_spans_of(part, bases, w), strict=True)]
            return (pa.array(out, pa.string(), mask=text.is_null().to_numpy(zero_copy_only=False)),)

        return run

    return map_columns(docs, ["text"], "text string", factory).select(*docs.columns)
