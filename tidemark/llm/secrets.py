"""Secret scans: three base patterns, and values in credential contexts judged by their guess cost."""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mapped, texts, with_id

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names that give what follows them the context of a credential.
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|client|account|encryption)[_-]?(?:key|secret|token)|auth|bearer|passwort|kennwort|contraseña|clave|mot[_ ]de[_ ]passe|mdp)["']?\x20{0,3}(?:=>|:=|[:=])\x20{0,3}["']?([^\s"'<>,;`]{6,})""",
    re.I,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "kennwort", "contrase", "clave", "mdp")
#: Base-2 logarithm of the guesses from which a value is a secret; of letters alone, which may be words of any language.
GUESS_BITS, LETTER_BITS = 45.0, 64.0

#: Frequent passwords and the words that placeholders are made of, by rank.
COMMON = """password admin user test example changeme your here my secret token key default none null true false root
login welcome letmein master guest demo sample dummy placeholder enter insert value string the this that is not set empty
hidden removed redacted dragon monkey football baseball sunshine princess shadow superman batman trust no love hello access
pass word code pin api auth name email server data base system service public private client account with from for and in
de la le der die das el los que und et env config process foo bar baz xxx abc qwerty iloveyou summer winter spring autumn
monday january michael charlie jordan hunter ranger soccer killer pepper ginger cookie""".split()
#: Rows of common keyboards, and the sequences people count along.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "1234567890", "!@#$%^&*()", "abcdefghijklmnopqrstuvwxyz", "0123456789", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik")
STEP = {(a, b) for w in WALKS for a, b in zip(w, w[1:], strict=False)}
STEP |= {(b, a) for a, b in STEP}
#: Letters that digits and signs are written for.
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_BITS = {4: math.log2(100), 8: math.log2(36_500), 10: math.log2(36_500)}
CLASSES = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[^0-9A-Za-z]"), 33))


#: Periods of repeats that are looked for, and the fewest characters of a walk.
PERIODS, LEAST_WALK = range(1, 9), 3
START_BITS = math.log2(len(WALKS) * 10)


class Words(dict):
    """Word to rank, from 1: the frequent ones above, then those of a list by its order, in lower case."""

    def __init__(self, more: Iterable[str] = ()):
        super().__init__()
        for w in (*COMMON, *more):
            self.setdefault(w.lower(), len(self) + 1)
        self.longest = max(map(len, self))


def vocabulary_words(path: str) -> list[str]:
    """The words of three letters or more that a byte-pair vocabulary has whole, in its order, which is about that of their frequency."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [t[1:] for t in sorted(vocab, key=vocab.get) if re.fullmatch("Ġ[A-Za-z]{3,}", t)]


FEW = Words()


class Starts:
    """Where open runs may have begun, by place, without those that a later and cheaper place makes useless."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.cost: list[float] = []

    def add(self, at: int, cost: float) -> None:
        while self.cost and self.cost[-1] >= cost:
            self.at.pop()
            self.cost.pop()
        self.at.append(at)
        self.cost.append(cost)

    def least(self, first: int, end: int, period: int) -> float:
        """The least cost of a start from first on, and the bits of the number of periods from there to end."""
        k = bisect_left(self.at, first)
        return min((c + (-(-(end - i) // period) - 1).bit_length() for i, c in zip(self.at[k:], self.cost[k:], strict=True)), default=math.inf)


def guess_bits(value: str, words: Words = FEW, enough: float = math.inf) -> float:
    """Base-2 logarithm of the guesses that value needs: the least over all its cuts into words, dates, repeats, walks and brute-force spans.

    best[j] is the least cost of the first j characters. Brute force costs as many bits for each character as its classes
    ask for. Other segments cost one bit for the cut and: a word its rank, capitals and signs for letters; a date that of its
    kind; a walk its start and length; a repeat its first period and number. Walks and repeats may begin at any place of
    a run, so a run keeps its possible starts. At enough bits whatever follows, the search ends early.
    """
    n = len(value)
    each = math.log2(16 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit() else max(2, sum(k for c, k in CLASSES if c.search(value))))
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    best = [0.0]
    walk_from, walks = 0, Starts()
    same = dict.fromkeys(PERIODS, 0)  # how many characters before here equal those one period before them
    repeats = {p: [Starts() for _ in range(p)] for p in PERIODS}
    for j in range(1, n + 1):
        cost = best[j - 1] + each
        for size in range(2, min(words.longest, j) + 1):
            i = j - size
            for piece, extra in ((low[i:j], 0.0), (plain[i:j], 2.0)):
                if (rank := words.get(piece)) and best[i] + 1 + extra < cost:
                    upper = sum(c.isupper() for c in value[i:j])
                    cost = min(cost, best[i] + 1 + math.log2(rank + 1) + extra + (0 if not upper else 1 if upper in (1, size) else size))
        for size, bits in DATE_BITS.items():
            if j >= size and value[j - 1].isdigit() and DATE.fullmatch(value, j - size, j):
                cost = min(cost, best[j - size] + 1 + bits)
        if j > 1 and (low[j - 2], low[j - 1]) not in STEP:
            walk_from, walks = j - 1, Starts()
        if j - walk_from >= LEAST_WALK:
            walks.add(j - LEAST_WALK, best[j - LEAST_WALK])
            cost = min(cost, walks.least(walk_from, j, 1) + 1 + START_BITS)
        first = walk_from
        for p in PERIODS:
            same[p] = same[p] + 1 if j > p and value[j - 1] == value[j - 1 - p] else 0
            if same[p] >= p:
                starts = repeats[p][j % p]
                starts.add(j - 2 * p, best[j - 2 * p])
                cost = min(cost, starts.least(j - p - same[p], j, p) + 1 + p * each)
            first = min(first, j - p - same[p])
        best.append(cost)
        if not j % 64 and j - first < 64 and min(best[min(first, max(0, j - max(16, words.longest))) :]) >= enough:
            return enough
    return best[n]


def spans(text: str, words: Words = FEW) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every secret: base matches, and values in credential contexts that cost enough guesses unless base matches cover all of them."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in CONTEXT_WORDS) or "passwd" in low:
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
            more = [m for m in CONTEXT.finditer(text) if guess_bits(m[1], words, least := LETTER_BITS if m[1].isalpha() else GUESS_BITS) >= least]
        else:
            more = []
    else:
        more = []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if more:
        begins, ends = [], []  # stretches that base matches cover
        for a, b, _ in sorted(found):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        for m in more:
            i = bisect_right(begins, m.start()) - 1
            if i < 0 or ends[i] < m.end():
                found.append((m.start(), m.end(), 3))
    return sorted(found)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def masked(text: str, found: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each of docs: id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, masked_text. Whole texts, no shuffle.

    A span is a whole match, in code points, end exclusive; spans are ordered by start, then kind as in KINDS.
    Null and empty texts have no spans; masked_text is null where the text is. Null ids and repeated rows are kept.
    Columns of docs beside the two are ignored, whatever their names. vocabulary: path of a byte-pair vocabulary, read by
    the driver, whose words rank behind the frequent ones; a list of words is as large as that file, whatever docs are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Words(vocabulary_words(vocabulary)) if vocabulary else FEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            sums, said, clean = [], [], []
            for text, valid in zip(texts(batch, "text"), batch.column(1).is_valid().to_pylist(), strict=True):
                found = spans(text, words)
                for k in range(4):
                    n[k].append(sum(x[2] == k for x in found))
                sums.append(hashlib.sha256(told([x for x in found if x[2] < 3]).encode()).hexdigest())
                said.append(told(found))
                clean.append(masked(text, found) if valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sums, pa.string()), pa.array(said, pa.string()), pa.array(clean, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "masked_text"])

    return mapped(docs.select(docs[id_col], docs[text_col].alias("text")), run, with_id(docs, id_col, "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, masked_text string"))
