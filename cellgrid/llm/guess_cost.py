"""Secret scans by the cost of guessing.

Values in credential contexts are segmented by dynamic programming into words, dates, repeats, sequences, keyboard walks and
brute-force spans, each with a number of guesses; the cheapest segmentation gives the value's guess cost. Words cost their
rank in a dictionary: fixed credential words first, then the corpus's own words by frequency, counted over all texts.
Three fixed patterns (assign, access, hex) are always reported; in wider contexts a value is reported only if its guess cost
is high, so ordinary words after such a label are left alone: after a credential's label, in connection strings, in key
blocks, and, at a much higher cost, after any name (key=value, YAML, .env, JSON and header lines).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

#: The base patterns, as the contract fixes them.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs of at least 24 hexadecimal letters: what the base pattern `[0-9a-f]+` keeps.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "context", "url", "key_block", "value")

#: Wider contexts, looked at only where one of these marks is in the text.
CONTEXT = re.compile(r"(?ai:\b(?:pass_?phrase|passcode|pwd|credentials?|authorization|bearer|auth_?key|access_?key|private_?key|client_?secret|session_?id)\b)[\"']?\x20*(?:[:=]|\x20is\x20|\x20)\x20*(?ai:bearer\x20+|basic\x20+)?[\"']?([^\s\"'<>|,;]{6,})")
URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s:/@]{4,}+)@[\w.-]+")
KEY_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
#: What stands between the mark of a block that was cut off and the next block's.
KEY_LINES = re.compile(r"[A-Za-z0-9+/=\s]*")
KEY_LEAST = 16
#: A value after any name.
NAMED = re.compile(r"(?<=[\w\"'\]])\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_=.$!#%^&*~-]{16,})")
_ASSIGN_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_MARKS = ("pass", "pwd", "credential", "auth", "bearer", "key", "secret", "session")

#: log10 of the guesses from which a value in a wider context counts as a secret.
THRESHOLD = 8.0
#: The same for a value after any name.
NAMED_THRESHOLD = 20.0
#: Words of the dictionary that the corpus gives, and the lengths of words that it holds: with both, the dictionary is at most 4 MB of letters.
DICTIONARY_WORDS = 1 << 14
WORD_LENGTHS = (3, 255)
FLUSH = 400_000

#: Words of credentials and configuration in order of use; a word costs its rank in guesses.
WORDS = "password admin user root test guest login welcome letmein master dragon monkey shadow sunshine princess football baseball iloveyou secret token default changeme example sample demo public private server database system service client local localhost production staging development access account company office support manager internet computer superman batman hello world love summer winter spring autumn monday friday january october november december my the your for and with this that none null true false value string required unknown hidden removed redacted placeholder".split()
#: Keyboard rows, along which walks go.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_LEET = str.maketrans("@430!1$5", "aaeoiiss")
_DAY = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
_VOWELS = frozenset("aeiouyáéíóúàèâêîôûäöü")


def word_lengths(words: Iterable[str]) -> list[int]:
    """The lengths of the words that are long enough to count, shortest first."""
    return sorted({len(w) for w in words if len(w) >= WORD_LENGTHS[0]})


class Ranks(dict):
    """Words with their ranks, and the lengths that words have, so that a value is only cut where a word can end."""

    def __init__(self, words: Iterable[str]):
        super().__init__((w, k) for k, w in enumerate(dict.fromkeys(words), 1))
        self.lengths = word_lengths(self)


_RANK = Ranks(WORDS)


def _next_to(a: str, b: str) -> bool:
    """Whether two keys touch (in a row, or in the rows above and below)."""
    if a not in _AT or b not in _AT:
        return False
    (r, k), (s, m) = _AT[a], _AT[b]
    return abs(r - s) <= 1 and abs(k - m) <= 1 and a != b


def _char_cost(c: str) -> float:
    """log10 of the guesses for one brute-force character of a class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str, ranks: Mapping[str, int] = _RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of `value`; 0 for an empty one. `ranks` is the dictionary.

    best[j] is the cheapest way to the first j characters: from some i by one segment. Runs (repeats, sequences, walks)
    cost a start, a step and a length; words cost their rank, doubled for capitals or look-alike signs; dates cost the days
    of a century; a letter in a pronounceable run (vowels among consonants, as in any language's words) costs less than a
    random one. Each further segment costs a little, as an attacker must try the splits.
    """
    s = value
    n, low = len(s), s.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    mixed = any(c.isdigit() for c in s) + any(c.isupper() for c in s) + any(c.islower() for c in s)
    extra = 0.3 * max(0, mixed - 1)  # a character of a mixed value comes from a larger alphabet
    split = math.log10(2)
    chars = [_char_cost(c) for c in s]
    lengths = ranks.lengths if isinstance(ranks, Ranks) else word_lengths(ranks)
    repeats = repeated_blocks(s)
    up, down = (_run_ends(n, lambda j, step=step: ord(s[j]) - ord(s[j - 1]) == step) for step in (1, -1))
    walks = _run_ends(n, lambda j: _next_to(low[j - 1], low[j]))
    ends, vowels = _like_words(s, low)
    for i in range(n):
        at = best[i] + (split if i else 0)

        def to(j: int, cost: float, at: float = at) -> None:
            if at + cost < best[j]:
                best[j] = at + cost

        if best[i] + chars[i] + extra < best[i + 1]:
            best[i + 1] = best[i] + chars[i] + extra
        for size in lengths:  # words
            if (j := i + size) > n:
                break
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                to(j, math.log10(rank + 1) + (split if s[i:j] != low[i:j] else 0) + (split if low[i:j] not in ranks else 0))
        if s[i].isdigit():
            if m := _DAY.match(s, i):
                to(m.end(), math.log10(36500) + split)
            if _YEAR.match(s, i):
                to(i + 4, math.log10(119))
        for size, j in repeats[i]:  # one character, or a block, again and again
            to(j, sum(chars[i : i + size]) + math.log10(j - i))
        for j in (up[i], down[i]):  # 123, cba
            if j - i >= 3:
                to(j, math.log10(10 if s[i].isdigit() else 26) + math.log10(2 * (j - i)))
        j = walks[i]
        if j - i >= 4:  # qwer, 1qaz
            to(j, math.log10(47) + (j - i - 1) * math.log10(2.3))
        j = ends[i]
        if j - i >= 4 and 0.2 <= (vowels[j] - vowels[i]) / (j - i) <= 0.7:
            to(j, 0.42 * (j - i) + 0.6)
    return best[n]


def _common_starts(s: Sequence) -> list[int]:
    """For each place, how many items from there on equal the first ones (the z-function)."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1) if n else [], 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _periodic_stretches(s: str) -> set[tuple[int, int, int]]:
    """(start, end, period) of every stretch of at least two periods that cannot be longer, for all periods.

    By halves: a stretch across a middle holds the place one period after it or one before it, and how far the text there
    agrees with the text at the middle, both ways, gives its ends. All halves of one depth take one pass over `s`; the number
    of depths is the logarithm of its length. Parts of a stretch may come beside the whole.
    """
    found, parts = set(), [(0, len(s))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        parts += [(lo, mid), (mid, hi)]
        u, v, whole = s[lo:mid], s[mid:hi], s[lo:hi]
        ahead = _common_starts([*v, None, *whole])[len(v) + 1 :]  # of each place with the middle, forwards
        behind = _common_starts([*u[::-1], None, *whole[::-1]])[len(u) + 1 :][::-1]  # of what ends with each place with what ends before the middle
        for p in range(1, max(len(u), len(v)) + 1):
            for at in (mid + p, mid - p):
                if lo <= at <= hi:
                    start = min(at, mid) - (behind[at - lo - 1] if at > lo else 0)
                    end = max(at, mid) + (ahead[at - lo] if at < hi else 0)
                    if end - start >= 2 * p:
                        found.add((start, end, p))
    return found


def repeated_blocks(s: str) -> list[list[tuple[int, int]]]:
    """For each place, (size, end) of the blocks from there that come twice or more in a row, a single character three times or more, as far as they go.

    Blocks of any size count, but none that is itself a repeat: the smaller block costs less and goes as far or further.
    """
    least: dict[tuple[int, int], int] = {}
    for a, b, p in _periodic_stretches(s):
        least[a, b] = min(p, least.get((a, b), p))
    out: list[dict[int, int]] = [{} for _ in s]
    for (a, b), p in least.items():
        for i in range(a, b - max(2 * p, 3) + 1):
            out[i][p] = max(out[i].get(p, 0), i + (b - i) // p * p)
    return [sorted(x.items()) for x in out]


def _run_ends(n: int, goes_on: Callable[[int], bool]) -> list[int]:
    """For each place, where the run from there ends; it goes on to character j where `goes_on(j)`."""
    out = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if goes_on(i + 1):
            out[i] = out[i + 1]
    return out


def _like_words(s: str, low: str) -> tuple[list[int], list[int]]:
    """For each place, where what is like a word ends (small letters after any letter, up to four without a vowel), and how many vowels are before it."""
    n = len(s)
    vowels, ends = [0] * (n + 1), [0] * n
    for i in range(n):
        vowels[i + 1] = vowels[i] + (low[i] in _VOWELS)
    small, stop = n, n + 1  # ends of the small letters from i + 1 on, and of the first four of them without a vowel
    for i in range(n - 1, -1, -1):
        letter = s[i].isalpha() and (s[i].islower() or s[i].isupper())
        if small - i >= 4 and letter and vowels[i + 4] == vowels[i]:
            ends[i] = i + 4
        else:
            ends[i] = min(small, stop) if letter else i
        if letter and s[i].islower():
            stop = ends[i] if ends[i] == i + 4 and vowels[i + 4] == vowels[i] else stop
        else:
            small, stop = i, n + 1
    return ends, vowels


def key_blocks(t: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of the key blocks of a text, however long: from a BEGIN mark to the next END mark, or to another BEGIN where only key lines are between."""
    begin = None
    for m in KEY_MARK.finditer(t):
        if begin:
            body = t[begin.end() : m.start()]
            if len(body) >= KEY_LEAST and (m[1] == "END" or KEY_LINES.fullmatch(body)):
                yield begin.start(), m.end() if m[1] == "END" else m.start(), body
        begin = m if m[1] == "BEGIN" else None


class Spans:
    """Intervals that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.held: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if self.held and a < self.held[-1][1]:
                self.held[-1] = (self.held[-1][0], max(b, self.held[-1][1]))
            else:
                self.held.append((a, b))

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.held, (b,))
        return not k or self.held[k - 1][1] <= a

    def add(self, a: int, b: int) -> None:
        insort(self.held, (a, b))


def find_secrets(text: str | None, ranks: Mapping[str, int] = _RANK) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, int, int]]]:
    """(all spans as (start, kind, end, guess cost), base spans as (start, kind, end)) of one whole text; null counts as empty.

    Base spans may overlap each other; the others overlap none, and of two of them the kind that is named first stays.
    """
    t = text or ""
    low = t.lower()
    base: list[tuple[int, int, int]] = []
    values: list[str] = []
    if any(m in low for m in _ASSIGN_MARKS):
        for m in ASSIGN.finditer(t):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, m.end()))
                values.append(m[2])
    if "AKIA" in t:
        for m in ACCESS.finditer(t):
            if m.end() - m.start() >= 20:
                base.append((m.start(), 1, m.end()))
                values.append(m[0])
    for m in HEX.finditer(t):
        base.append((m.start(), 2, m.end()))
        values.append(m[0])
    found = [(*span, guess_cost(v, ranks)) for span, v in zip(base, values, strict=True)]
    held = Spans([(a, b) for a, _, b in base])

    def add(kind: int, start: int, end: int, value: str, least: float = THRESHOLD) -> None:
        if held.free(start, end) and (cost := guess_cost(value, ranks)) >= least:
            held.add(start, end)
            found.append((start, kind, end, cost))

    if any(m in low for m in _CONTEXT_MARKS):
        for m in CONTEXT.finditer(t):
            value = m[1].rstrip(".:)]}")
            add(3, m.start(1), m.start(1) + len(value), value, THRESHOLD if any(c.isdigit() for c in value) else 2 * THRESHOLD)
    if "://" in t:
        for m in URL.finditer(t):
            add(4, m.start(1), m.end(1), m[1], THRESHOLD / 2)
    if "PRIVATE KEY-----" in t:
        for start, end, body in key_blocks(t):
            add(5, start, end, "".join(body.split()))
    for m in NAMED.finditer(t):
        value = m[1].rstrip(".")
        if value[0] not in "/.~" and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):  # no paths
            add(6, m.start(1), m.start(1) + len(value), value, NAMED_THRESHOLD)
    return sorted(found), sorted(base)


def ranked_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> Ranks:
    """The dictionary: the fixed words, then at most `most` of the most frequent words of letters in all texts, each with its rank; words of one count are in it together or not at all.

    Words are counted in the tasks and by Spark. How many words have each count gives the least count that counts, so only
    the list itself, of a fixed size, comes to the driver.
    """
    least, longest = WORD_LENGTHS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            w = [w for w in seen if least <= len(w) <= longest and w.isalpha()]
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([seen[x] for x in w], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update((t or "").lower().split())
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = words.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    top = words.where(F.col("n") >= (least if least is not None else 1 << 62)).collect()
    dropped(words)
    return Ranks([*WORDS, *(r.word for r in sorted(top, key=lambda r: (-r.n, r.word)))])


def _join(spans: list) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def scan_documents(docs: DataFrame, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_secrets and hardest (log10 guesses).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null, empty and clean texts have no
    spans, zeros, the hash of the empty string and a null `hardest`. Null and repeated doc_ids are kept, one row each. Texts
    are not shuffled. Without `ranks`, the dictionary is counted from all texts of `docs` first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(docs) if ranks is None else ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                spans, base = find_secrets(t, shared.value)
                row = (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(spans), max((s[3] for s in spans), default=None))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_secrets", "hardest"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_secrets bigint, hardest double")


def op4_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return scan_documents(table(spark, sf_dir, "documents"))
