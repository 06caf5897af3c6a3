"""Secrets in texts: fixed patterns, and spans tagged by a conditional random field.

The field tags tokens as outside, begin or inside of a secret. Tokens are runs of ASCII
letters and digits and all other single characters but white space. Features are the
token's shape and that of its neighbours, the words before it (cues of secrets and of
plain ids, by their distance), the marks around it (assignment, quotes, the password place
of a URL), and features of the file (code, configuration, log or prose, told by its lines),
alone and together with the shape.

All tokens of a text are decoded, as one chain (``Decoder``). ``tagged_spans`` is the plain
form of the same, one token at a time; its *hot* ranges (``candidates``, ``cued``), to which
the field was once confined, serve comparisons in the tests only.

Nobody has labelled secrets here, so the model is fitted on generated files of four kinds
with known secrets and look-alikes, from a fixed seed.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm import crf
from sparkgauge.llm import kernels as K

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer characters fails, and no match begins inside a run
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SECRET_WORDS = frozenset("password passwd pwd pass passphrase secret secrets token apikey api_key key auth authorization bearer basic credential credentials private login pin".split())
_PLAIN_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid id ref version release sku order serial part model build file image trace request session invoice isbn phone tel fax call card".split())
_PREFIXES = ("AKIA", "ASIA", "ghp", "gho", "sk", "xox", "AIza", "eyJ", "glpat", "npm")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\s]")
_CUE = re.compile(r"password|passwd|pwd|passphrase|secret|token|api[_ -]?key|auth|bearer|basic|credential|private[_ -]?key|access[_ -]?key|login|\bpass\b|\bkey\b|\bpin\b|://", re.IGNORECASE)
_FIELD = re.compile(r"\S+")
#: Fields after a cue that are hot, and tokens decoded on both sides of hot fields.
AFTER, AROUND = 3, 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


@lru_cache(1 << 16)
def _shape(token: str) -> tuple[float, ...]:
    n = len(token)
    digits, lower, upper = sum(c.isdigit() for c in token), sum(c.islower() for c in token), sum(c.isupper() for c in token)
    flips = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
    bits = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    word = token.isalnum()
    marks = [word and low <= n <= high for low, high in ((1, 2), (3, 4), (5, 7), (8, 11), (12, 15), (16, 19), (20, 31), (32, 39), (40, 40), (41, 1 << 30))]
    marks += [word and digits == 0, 0 < digits <= 0.2 * n, 0.2 * n < digits <= 0.5 * n, 0.5 * n < digits < n, word and digits == n]
    marks += [word and upper == 0, word and lower == 0 and upper > 0, lower > 0 and upper > 0 and digits > 0, flips >= 2, word and upper == 1 and token[0].isupper() and digits == 0]
    marks += [word and bits < 2.5, 2.5 <= bits < 3.2, 3.2 <= bits < 3.8, bits >= 3.8]
    marks += [word and not set(token.lower()) - set("0123456789abcdef"), token.startswith(_PREFIXES), token.lower() in _SECRET_WORDS, token.lower() in _PLAIN_WORDS]
    marks += [token == c for c in "-_./+=:@"] + [not word and token not in "-_./+=:@"]
    return tuple(map(float, marks))


SHAPE, LETTERS, ALL_DIGITS, HEX, SECRET_WORD, PLAIN_WORD = len(_shape("a")), 10, 14, 24, 26, 27
FILES, CUES = 4, 18
WIDTH = 1 + 3 * SHAPE + CUES + FILES * 5


def _shapes(tokens: list[str]) -> np.ndarray:
    """``_shape`` of each token; those of several characters, all ASCII letters and digits, as arrays."""
    out = np.zeros((len(tokens), SHAPE))
    many = []
    for k, x in enumerate(tokens):
        if len(x) > 1:
            many.append(k)
        else:
            out[k] = _shape(x)
    if not many:
        return out
    words = [tokens[k] for k in many]
    raw = np.frombuffer("".join(words).encode("ascii"), np.uint8)
    n = np.array([len(x) for x in words], np.int64)
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(words)), n)
    up, low, digit = (raw >= 65) & (raw < 91), (raw >= 97) & (raw < 123), raw < 58
    count = lambda hits: np.add.reduceat(hits.astype(np.int64), first)
    flip = np.concatenate([[False], low[:-1] & up[1:]])
    flip[first] = False
    digits, lower, upper, flips = count(digit), count(low), count(up), count(flip)
    key = np.sort(own * 128 + raw)
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    of = key[heads] >> 7
    p = np.diff(heads, append=len(key)) / n[of]
    bits = np.bincount(of, -p * np.log2(p), len(words))
    marks = [(low_ <= n) & (n <= high) for low_, high in ((1, 2), (3, 4), (5, 7), (8, 11), (12, 15), (16, 19), (20, 31), (32, 39), (40, 40), (41, 1 << 30))]
    marks += [digits == 0, (digits > 0) & (digits <= 0.2 * n), (digits > 0.2 * n) & (digits <= 0.5 * n), (digits > 0.5 * n) & (digits < n), digits == n]
    marks += [upper == 0, (lower == 0) & (upper > 0), (lower > 0) & (upper > 0) & (digits > 0), flips >= 2, (upper == 1) & up[first] & (digits == 0)]
    marks += [bits < 2.5, (bits >= 2.5) & (bits < 3.2), (bits >= 3.2) & (bits < 3.8), bits >= 3.8]
    marks += [count(digit | ((raw | 32) >= 97) & ((raw | 32) <= 102)) == n, [x.startswith(_PREFIXES) for x in words], [x.lower() in _SECRET_WORDS for x in words], [x.lower() in _PLAIN_WORDS for x in words]]
    out[many, : len(marks)] = np.column_stack(marks)
    return out


def file_features(text: str) -> list[float]:
    """Whether a text looks like code, configuration, a log or prose, by its lines (a share of at least a quarter)."""
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda ok: float(4 * sum(map(ok, lines)) >= max(len(lines), 1))
    code = share(lambda x: x.rstrip().endswith((";", "{", "}", "):")) or x.lstrip().startswith(("def ", "import ", "return ", "//", "#include")))
    config = share(lambda x: _SETTING.match(x) is not None)
    log = share(lambda x: _STAMP.match(x) is not None)
    return [code, config * (1 - code) * (1 - log), log, float(not (code or config or log))]


_SETTING = re.compile(r"\s*[\w.\-\"]{1,40}\s*[=:]\s*\S{1,200}\s*,?\s*$")
_STAMP = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]")


def _features(text: str, spans: list[tuple[int, int]], file: list[float]) -> np.ndarray:
    """One row for each of consecutive tokens."""
    tokens = [text[a:b] for a, b in spans]
    n = len(tokens)
    shapes = np.array([_shape(t) for t in tokens]).reshape(n, SHAPE)
    x = np.zeros((n, WIDTH))
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPE] = shapes
    x[1:, 1 + SHAPE : 1 + 2 * SHAPE] = shapes[:-1]
    x[:-1, 1 + 2 * SHAPE : 1 + 3 * SHAPE] = shapes[1:]
    last = {"secret": -1 << 20, "plain": -1 << 20}
    words = 0
    for k, ((a, b), token) in enumerate(zip(spans, tokens, strict=True)):
        gap = text[spans[k - 1][1] : a] if k else "\n"
        if "\n" in gap:
            last = dict.fromkeys(last, -1 << 20)
        word = token.isalnum() and token.isascii()
        words += word
        before = [t for t in tokens[max(0, k - 3) : k] if t not in "\"'`"]
        assigned = bool(before) and before[-1] in "=:" and "\n" not in text[spans[k - 1][0] : a]
        far, plain = words - last["secret"], words - last["plain"]
        shape = shapes[k]
        cues = [
            word and far == 1, word and far == 2, word and 3 <= far <= 4, word and 5 <= far <= 7, word and plain <= 2, word and 3 <= plain <= 5,
            assigned, assigned and far <= 2, gap == "", "\n" in gap, k > 0 and tokens[k - 1] in "\"'`" and gap == "", text[b : b + 1] in tuple("\"'`"),
            _in_url(text, a, b), word and far <= 3 and shape[LETTERS], word and far <= 3 and shape[ALL_DIGITS], word and far <= 4 and not shape[LETTERS] and not shape[ALL_DIGITS],
            text[b : b + 1] in tuple("=:("), word and assigned and far <= 3 and b - a >= 8,
        ]
        x[k, 1 + 3 * SHAPE : 1 + 3 * SHAPE + CUES] = cues
        if token.lower() in _SECRET_WORDS:
            last["secret"] = words
        elif token.lower() in _PLAIN_WORDS:
            last["plain"] = words
    at = 1 + 3 * SHAPE + CUES
    for j, on in enumerate(file):
        if on:
            x[:, at + 5 * j] = 1
            x[:, at + 5 * j + 1] = shapes[:, HEX]
            x[:, at + 5 * j + 2] = shapes[:, LETTERS]
            x[:, at + 5 * j + 3] = shapes[:, 11:14].sum(1)
            x[:, at + 5 * j + 4] = x[:, 1 + 3 * SHAPE + 10]
    return x


def _in_url(text: str, a: int, b: int) -> float:
    """Whether a range lies in the password of scheme://user:password@host."""
    if text[max(0, a - 80) : a].rfind("://") < 0:
        return 0.0
    left = re.search(r"://[^\s/:@]+:[^\s/@]*$", text[max(0, a - 80) : a])
    return float(left is not None and re.match(r"[^\s/@]*@", text[b : b + 80]) is not None)


_HEXA, _LOW, _UP, _NUM = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def generated(seed: int = 7, files: int = 400) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, secret ranges) of made-up files of the four kinds."""
    r = random.Random(seed)
    pick = lambda chars, low, high: "".join(r.choice(chars) for _ in range(r.randint(low, high)))
    alnum = _LOW + _UP + _NUM
    word = lambda: pick(_LOW, 2, 9)
    words = lambda low, high: " ".join(word() for _ in range(r.randint(low, high)))

    def secret() -> str:
        return r.choice([
            lambda: pick(alnum, 16, 44), lambda: pick(_HEXA, 24, 40), lambda: r.choice(["ghp_", "gho_", "npm_"]) + pick(alnum, 30, 36), lambda: r.choice(["sk-", "sk_live_", "glpat-"]) + pick(alnum, 20, 40),
            lambda: "AIza" + pick(alnum, 30, 35), lambda: "xoxb-" + pick(_NUM, 10, 12) + "-" + pick(alnum, 20, 24), lambda: ".".join(("eyJ" + pick(alnum, 15, 30), pick(alnum, 20, 60), pick(alnum, 20, 40))),
            lambda: "-".join(pick(alnum, 3, 5) for _ in range(r.randint(4, 6))), lambda: pick(alnum, 12, 20) + r.choice("+/-_") + pick(alnum, 12, 20) + r.choice(["", "=", "=="]),
        ])()

    def password() -> str:  # known only by its cue
        return r.choice([
            lambda: word() + pick(_NUM, 1, 4), lambda: word().title() + pick(_NUM, 2, 4) + r.choice("!#$") if r.random() < 0.5 else word() + word() + pick(_NUM, 2, 2), lambda: pick(_LOW, 12, 22),
            lambda: pick(_NUM, 8, 16), lambda: pick(alnum, 8, 12), lambda: "-".join(word() for _ in range(4)), secret, lambda: pick(_LOW, 3, 5) + pick(_UP, 1, 3) + pick(_NUM, 2, 4),
        ])()

    def plain() -> str:
        return r.choice([
            lambda: pick(_HEXA, 7, 12), lambda: pick(_HEXA, 40, 40), lambda: "-".join((pick(_HEXA, 8, 8), *(pick(_HEXA, 4, 4) for _ in range(3)), pick(_HEXA, 12, 12))), lambda: pick(_UP, 2, 3) + "-" * r.randint(0, 1) + pick(_NUM, 6, 10),
            lambda: word() + pick(_NUM, 1, 5) + "." + r.choice(["png", "html", "pdf", "js"]), lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}-alpha{r.randint(1, 99)}", lambda: word() + word().title() + word().title(),
            lambda: f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}Z", lambda: f"{word()}.{word()}{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.{r.choice(['com', 'org', 'example.net'])}",
            lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), lambda: f"+{r.randint(1, 99)} ({pick(_NUM, 3, 3)}) {pick(_NUM, 3, 3)}-{pick(_NUM, 4, 4)}", lambda: r.choice([" ", "-", ""]).join(pick(_NUM, 4, 4) for _ in range(4)),
            lambda: f"https://{word()}.{word()}.com/{word()}/{pick(_NUM, 3, 9)}?{word()}={pick(_NUM, 1, 6)}", lambda: f"/{word()}/{word()}{r.randint(2, 3)}.{r.randint(1, 12)}/{word()}_{r.randint(1, 99)}", lambda: pick(_NUM, 10, 13), lambda: f"{word()}_{word()}_{r.randint(1, 64)}",
            lambda: f"{word()}_{word()}", lambda: f"#{pick(_HEXA, 6, 6)}", lambda: f"{pick(_NUM, 1, 3)},{pick(_NUM, 3, 3)}.{pick(_NUM, 2, 2)}", lambda: f"{word().title()}-{word()}-{word()}", lambda: f"978-{pick(_NUM, 1, 1)}-{pick(_NUM, 4, 5)}-{pick(_NUM, 3, 4)}-{pick(_NUM, 1, 1)}",
        ])()

    cue = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth_token", "client_secret", "db_password", "login", "credential", "PASSWORD", "API_KEY", "Token", "Secret"])
    tag = lambda: r.choice(["commit", "sha256", "uuid", "id", "ref", "serial", "order", "file", "version", "checksum", "trace", "request", "host", "path", "name", "user", "build", "image", "url", "invoice", "phone", "mail", "ip", "port", "date"])

    def parts(kind: int) -> list:
        """A line as texts and (secret,) in turn."""
        odds = r.random()
        if kind == 0:  # code
            quote = r.choice("\"'")
            if odds < 0.3:
                return [f"{r.choice(['', '  ', 'const ', 'var '])}{r.choice(['', word() + '_', 'self.'])}{cue()}{r.choice([' = ', '=', ': '])}{quote}", (password(),), quote + r.choice([";", ",", ""])]
            if odds < 0.36:
                return [f"{word()}({quote}{r.choice(['Bearer ', 'Basic ', 'token '])}", (secret(),), f"{quote});"]
            if odds < 0.44:
                return [f"{word()} = {quote}", (secret(),), f"{quote};"]
            if odds < 0.7:
                return [f"{r.choice(['', '  '])}{tag()} = {quote}{plain()}{quote};"]
            return [r.choice([f"def {word()}_{word()}({word()}, {word()}):", f"return {word()}{word().title()}({word()});", f"import {word()}.{word()}", f"if ({cue()} == null) {{", f"{cue()} = get{word().title()}({word()});", f"// {words(3, 8)}", f"{cue()} = os.environ[{quote}{cue().upper()}{quote}];"])]
        if kind == 1:  # configuration
            join = r.choice(["=", ": ", " = ", ":"])
            if odds < 0.3:
                return [f"{r.choice(['', word() + '.', word() + '_'])}{cue()}{join}", (password(),)]
            if odds < 0.4:
                return [f"{word()}_url{join}{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{word()}:", (password(),), f"@{word()}{r.choice(['', '.' + word() + '.com'])}{r.choice(['', ':5432'])}/{word()}"]
            return [f"{tag()}{join}{r.choice([plain(), word(), str(r.randint(0, 9000)), 'true', f'{word()}-{word()}'])}"]
        if kind == 2:  # log
            stamp = f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}"
            if odds < 0.12:
                return [f"{stamp} {r.choice(['INFO', 'DEBUG'])} {words(1, 4)} {cue()}{r.choice(['=', ': ', ' '])}", (password(),), f" {words(0, 3)}"]
            if odds < 0.16:
                return [f"{stamp} DEBUG Authorization: {r.choice(['Bearer', 'Basic'])} ", (r.choice([secret(), pick(_NUM, 10, 16)]),)]
            return [f"{stamp} {r.choice(['INFO', 'WARN', 'ERROR'])} {words(1, 5)} {r.choice(['', tag() + '=', tag() + ' ', tag() + ': '])}{plain()} {words(0, 3)}"]
        if odds < 0.1:  # prose
            return [f"{words(0, 6)} {cue()} {r.choice(['is ', 'is: ', 'was ', '', '', '- ', '= '])}", (password(),), r.choice([".", f" {words(1, 4)}.", ""])]
        if odds < 0.16:
            return [f"{words(0, 6)} ", (secret(),), f" {words(0, 6)}."]
        if odds < 0.32:  # cues without a secret
            return [f"{words(0, 5)} {cue()} {r.choice(['of', 'and', 'to', 'for', 'must', 'was changed', 'in', 'below', 'reset', 'is required', 'policy', 'field', 'should not be', 'has'])} {words(2, 6)}."]
        if odds < 0.65:
            return [f"{words(0, 6)} {r.choice(['', tag() + ' ', tag() + ': ', 'the ' + tag() + ' '])}{plain()} {words(0, 6)}."]
        return [f"{words(4, 14).capitalize()}{r.choice(['.', ',', '!', '?'])} {words(0, 8).capitalize()}"]

    for k in range(files):
        text, ranges = "", []
        for _ in range(r.randint(3, 9)):
            for part in parts(k % 4):
                if isinstance(part, tuple):
                    ranges.append((len(text), len(text) + len(part[0])))
                    part = part[0]
                text += part
            text += "\n"
        yield text, ranges


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """(W, T) fitted on the generated files, each one chain; inside never follows outside."""
    rows, tags = [], []
    for text, ranges in generated():
        spans = [m.span() for m in _TOKEN.finditer(text)]
        rows.append(_features(text, spans, file_features(text)))
        inside = [next((low for low, high in ranges if low <= a and b <= high), None) for a, b in spans]
        tags.append([0 if low is None else 1 if low == a else 2 for (a, _), low in zip(spans, inside, strict=True)])
    gold = np.concatenate(tags)
    evidence = np.where(np.arange(3)[None, :] == gold[:, None], 0.0, -1e9)
    w, t = crf.train(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]), evidence, rounds=100, rate=0.2, decay=1e-3)
    t[0, 2] = -1e9
    return w, t


def tagged_spans(text: str, hot: list[tuple[int, int]] | None, w: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of secrets by Viterbi in the windows around hot ranges; without them over all tokens of the text."""
    if hot is not None and not hot:
        return []
    out, file = [], file_features(text)
    windows = [[0, len(text), [(0, len(text))]]] if hot is None else []
    for a, b in hot or ():
        # AROUND tokens are less than so many characters in plain text; a longer token fills the window by itself
        low, high = max(0, a - 24 * AROUND), min(len(text), b + 24 * AROUND)
        while low > 0 and _inside_token(text, low):
            low -= 1
        while high < len(text) and _inside_token(text, high):
            high += 1
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
            windows[-1][2].append((a, b))
        else:
            windows.append([low, high, [(a, b)]])
    for low, high, own in windows:
        spans = [m.span() for m in _TOKEN.finditer(text, low, high)]
        if not spans:
            continue
        emit = _features(text, spans, file) @ w
        starts = [a for a, _ in own]
        for k, (a, b) in enumerate(spans):
            j = bisect_right(starts, a) - 1
            if j < 0 or b > own[j][1]:
                emit[k, 1:] = -1e9
        path = crf.viterbi(emit, t)
        k = 0
        while k < len(path):
            if path[k] == 1:
                j = k + 1
                while j < len(path) and path[j] == 2:
                    j += 1
                out.append((spans[k][0], spans[j - 1][1], 3))
                k = j
            else:
                k += 1
    return out


def _inside_token(text: str, k: int) -> bool:
    left, right = text[k - 1], text[k]
    return left.isalnum() and right.isalnum() and left.isascii() and right.isascii()


def candidates(raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each text with any, the byte ranges (within the text) of the fields that are hot by their own characters."""
    start, end, _ = K.words(raw, offsets)
    long_ = end - start >= 8
    start, end = start[long_], end[long_]
    count = lambda hits: np.searchsorted(hits, end) - np.searchsorted(hits, start)
    lower, upper = (raw >= 97) & (raw < 123), (raw >= 65) & (raw < 91)
    digits, letters = count(np.flatnonzero((raw >= 48) & (raw < 58))), count(np.flatnonzero(lower | upper))
    flips = count(np.flatnonzero(lower[:-1] & upper[1:]) + 1)
    ok = ((digits > 0) & (letters > 0)) | (digits >= 10) | (flips >= 2)
    out: dict[int, list[tuple[int, int]]] = {}
    for s, e in zip(start[ok].tolist(), end[ok].tolist(), strict=True):
        i = int(np.searchsorted(offsets, s, "right")) - 1
        out.setdefault(i, []).append((s - int(offsets[i]), e - int(offsets[i])))
    return out


def cued(text: str) -> list[tuple[int, int]]:
    """The fields that are hot by a cue before them (or in them) on their line."""
    out, done = [], 0
    for m in _CUE.finditer(text):
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        begin = m.start()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        for k, f in enumerate(_FIELD.finditer(text, begin, end)):
            if k > AFTER:
                break
            if sum(c.isalnum() for c in f[0]) >= 5:
                out.append(f.span())
        done = m.end()
    return sorted(set(out))


def _points(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges that begin and end with characters as ranges of code points."""
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(at[a]), int(at[b])) for a, b in runs]


class Decoder:
    """Viterbi over all tokens of whole texts, many texts at once; equal to ``tagged_spans`` without hot ranges.

    The scores of all tokens are summed up as arrays: those of a token's shape are kept by
    token, those of its cues in a table of all their combinations. A stretch of begin and
    inside gains at most the sum of its tokens' best scores over outside, transitions
    included. Only tokens that some stretch with a sum of 0 or more holds can be other than
    outside on the best path, so the recursion runs on these alone, between tokens that are
    outside for sure.
    """

    #: Tokens whose shapes are kept, and their characters in all.
    TOKENS, CHARS = 1 << 17, 1 << 22

    def __init__(self, w: np.ndarray, t: np.ndarray) -> None:
        over = w[:, 1:] - w[:, :1]  # begin and inside over outside
        at = 1 + 3 * SHAPE + CUES
        self.t, self.bias, self.own, self.before, self.after = t, over[0], over[1 : 1 + SHAPE], over[1 + SHAPE : 1 + 2 * SHAPE], over[1 + 2 * SHAPE : 1 + 3 * SHAPE]
        self.files = over[at:].reshape(FILES, 5, 2)
        self.table = np.zeros((1, 2))
        for x in over[at - CUES : at]:
            self.table = np.concatenate([self.table, self.table + x])
        self.enter, self.stay, self.leave = max(t[:, 1]) - t[0, 0], max(t[1:, 2]) - t[0, 0], max(t[1:, 0]) - t[0, 0]
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.chars = 0
        self.marks = np.zeros((0, 9))
        self.scores = np.zeros((0, 6))

    def _known(self, tokens: list[str]) -> np.ndarray:
        """The row of each token in ``marks`` and ``scores``."""
        if len(self.ids) > self.TOKENS or self.chars > self.CHARS:
            self.clear()
        old, ids = len(self.ids), self.ids
        for x in set(tokens).difference(ids):
            ids[x] = len(ids)
            self.chars += len(x)
        if len(ids) > old:
            new = list(ids)[old:]
            shapes = _shapes(new)
            word = [x.isalnum() and x.isascii() for x in new]
            marks = [shapes[:, HEX], shapes[:, LETTERS], shapes[:, 11:14].sum(1), shapes[:, ALL_DIGITS], word, shapes[:, SECRET_WORD], shapes[:, PLAIN_WORD], [x in "\"'`" for x in new], [x in "=:" for x in new]]
            self.marks = np.concatenate([self.marks, np.column_stack(marks)])
            self.scores = np.concatenate([self.scores, np.hstack([shapes @ self.own + self.bias, shapes @ self.before, shapes @ self.after])])
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))

    def gains(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text, scores (2, n) over outside) of all tokens; places count within their text."""
        whole = "\n".join(texts) + "\n"  # no token, line or URL reaches over a text's end
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, len(_CLASS) - 1)
        kind = _CLASS[low]
        inside = kind == 2
        start = np.flatnonzero((kind == 1) | inside & ~np.concatenate([[False], inside[:-1]]))
        end = np.flatnonzero((kind == 1) | inside & ~np.concatenate([inside[1:], [False]])) + 1
        tokens = _TOKEN.findall(whole)
        n = len(tokens)
        assert n == len(start)
        known = self._known(tokens)
        del tokens
        marks, scores = self.marks, self.scores
        flag = lambda k: marks[:, k][known] > 0
        letters, digits, word, secret, quote, equal = flag(1), flag(3), flag(4), flag(5), flag(7), flag(8)
        plain = flag(6) & ~secret
        text = np.searchsorted(first, start, "right") - 1
        line = np.searchsorted(np.flatnonzero(points == 10), start)
        up = lambda x, k=1: np.concatenate([np.zeros(min(k, n), x.dtype), x[: max(n - k, 0)]])  # noqa: E731  of the token k before
        same = lambda k: np.concatenate([np.zeros(min(k, n), bool), text[k:] == text[: max(n - k, 0)]])
        fresh = np.concatenate([np.ones(min(n, 1), bool), line[1:] != line[:-1]])
        close = np.concatenate([np.zeros(min(n, 1), bool), start[1:] == end[:-1]])
        words = np.cumsum(word)

        def far(cue: np.ndarray) -> np.ndarray:
            """Words since the last cue before on the line."""
            last = np.concatenate([[-1], np.maximum.accumulate(np.where(cue, np.arange(n), -1))[:-1]])[:n]
            return np.where((last >= 0) & (line[last] == line), words - words[last], 1 << 20)

        away, off = far(secret), far(plain)
        assigned = ~fresh & (up(equal) | up(quote) & (same(2) & up(equal, 2) | up(quote, 2) & same(3) & up(equal, 3)))
        follows = points[np.minimum(end, len(points) - 1)]
        quoted, nears = close & up(quote), word & (away <= 3)
        cues = [
            word & (away == 1), word & (away == 2), word & (away >= 3) & (away <= 4), word & (away >= 5) & (away <= 7), word & (off <= 2), word & (off >= 3) & (off <= 5),
            assigned, assigned & (away <= 2), close, fresh, quoted, np.isin(follows, [34, 39, 96]),
            self._in_urls(whole, points, start, end), nears & letters, nears & digits, word & (away <= 4) & ~letters & ~digits,
            np.isin(follows, [61, 58, 40]), nears & assigned & (end - start >= 8),
        ]
        bits = np.zeros(n, np.int64)
        for k, x in enumerate(cues):
            bits |= x.astype(np.int64) << k
        out = self.table[bits]
        out += scores[known, :2]
        one = np.flatnonzero(same(1))
        out[one] += scores[known[one - 1], 2:4]
        out[one - 1] += scores[known[one], 4:]
        files = np.array([file_features(x) for x in texts]).reshape(len(texts), FILES)
        for k, x in enumerate([None, marks[:, 0][known], marks[:, 1][known], marks[:, 2][known], quoted]):
            of = (files @ self.files[:, k])[text]
            out += of if x is None else of * x[:, None]
        return start - first[text], end - first[text], text, out

    @staticmethod
    def _in_urls(whole: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        colon = np.flatnonzero((points[:-2] == 58) & (points[1:-1] == 47) & (points[2:] == 47))
        ats = np.flatnonzero(points == 64)
        if len(colon) and len(ats):
            near = np.searchsorted(colon, start - 3, "right") > np.searchsorted(colon, start - 80)
            near &= np.searchsorted(ats, end + 80) > np.searchsorted(ats, end)
            for k in np.flatnonzero(near).tolist():
                out[k] = _in_url(whole, int(start[k]), int(end[k]))
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, end, 3) of secrets."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        start, end, text, gain = self.gains(texts)
        n = len(start)
        if not n:
            return out
        heads = np.concatenate([[True], text[1:] != text[:-1]])
        most = np.maximum(gain[:, 0] + self.enter, gain[:, 1] + self.stay)
        most[heads] = gain[heads].max(1)  # nothing comes before a text's first token
        most[np.concatenate([heads[1:], [True]])] += max(0.0, -self.leave)  # nor after its last
        total = np.concatenate([[0.0], np.cumsum(most)])
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        open_ = best + self.leave >= -1e-6 * (1 + np.abs(total).max() * 1e-6)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            cuts = [low, *(low + 1 + np.flatnonzero(heads[low + 1 : high])).tolist(), high]
            for a, b in zip(cuts, cuts[1:], strict=False):
                path = self._path(gain[a:b].tolist(), bool(heads[a]), b == n or bool(heads[b]))
                k = 0
                while k < len(path):
                    m = k + 1
                    if path[k] == 1:
                        while m < len(path) and path[m] == 2:
                            m += 1
                        out[text[a]].append((int(start[a + k]), int(end[a + m - 1]), 3))
                    k = m
        return out

    def _path(self, gain: list[list[float]], head: bool, tail: bool) -> list[int]:
        """The best path of consecutive tokens that stand between tokens outside, or at an end of their text."""
        (t00, t01, t02), (t10, t11, t12), (t20, t21, t22) = self.t.tolist()
        back = []
        x, y, z = (0.0, *gain[0]) if head else (t00, gain[0][0] + t01, gain[0][1] + t02)
        for b, i in gain[1:]:
            o0, o1, o2 = x + t00, y + t10, z + t20
            b0, b1, b2 = x + t01, y + t11, z + t21
            i0, i1, i2 = x + t02, y + t12, z + t22
            so = 0 if o0 >= o1 and o0 >= o2 else 1 if o1 >= o2 else 2
            sb = 0 if b0 >= b1 and b0 >= b2 else 1 if b1 >= b2 else 2
            si = 0 if i0 >= i1 and i0 >= i2 else 1 if i1 >= i2 else 2
            back.append((so, sb, si))
            x, y, z = (o0, o1, o2)[so], (b0, b1, b2)[sb] + b, (i0, i1, i2)[si] + i
        if not tail:
            x, y, z = x + t00, y + t10, z + t20
        path = [0 if x >= y and x >= z else 1 if y >= z else 2]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


#: Of code points (the last one stands for all above): 0 white space, 1 a token by itself, 2 an ASCII letter or digit.
_CLASS = np.array([0 if re.match(r"\s", chr(c)) else 2 if chr(c).isascii() and chr(c).isalnum() else 1 for c in range(0x3002)], np.uint8)


def find_secrets(texts: pa.Array, w: np.ndarray, t: np.ndarray, decode: Decoder | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """For each text all spans (start, end, kind): the fixed ones, then what the field adds outside of them."""
    decode = decode or Decoder(w, t)
    raw, at = K.utf8(texts)
    for i, j in K.slices(at):
        part, own = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        whole = [part[own[k] : own[k + 1]].tobytes().decode() for k in range(j - i)]
        for text, tagged in zip(whole, decode(whole), strict=True):
            fixed = base_spans(text)
            yield sorted([*fixed, *(s for s in tagged if all(s[1] <= b[0] or b[1] <= s[0] for b in fixed))], key=lambda s: (s[0], s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and ``found``: an array of (kind, start, end) in code points.

    Null and empty texts have no spans; a null id stays null; repeated rows are scanned
    each; other columns are ignored; an empty table gives an empty result.
    """
    w, t = model()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(w, t)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans] for spans in find_secrets(batch.column(1), w, t, decode)]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return K.arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, a hash of their spans, and all spans as text."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    fixed = F.filter("found", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(fixed), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
