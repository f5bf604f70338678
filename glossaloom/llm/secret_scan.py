"""Secret scans: three fixed patterns, and formats learned by grammar inference.

Labelled credentials of each format are put in a prefix tree, and statistically
compatible states are merged (red and blue states, Hoeffding bound ``alpha``,
the nearest first) into a probabilistic automaton; a state that one character
always follows is like no other, and the start is never merged. Marks that
stand equally often in all credentials of a format part them; all other
characters are one class in the tree, so its branches are long and their ends
are what tells states apart: a body of fixed length keeps a state for each
place. Each transition also keeps how often every character was seen on it, so
what a format always says in one place (such as its first letters) makes other
strings unlikely there; there is no separate test for a prefix.

The background is the likeliest of several chains: one over character classes,
from class pairs counted over all documents, with the characters of a class
alike; and one for each kind of labelled text that looks like a credential and
is none (identifiers and paths, encoded prose at each of its four alignments),
over characters.

Candidates are runs of credential characters, and parts of them: from the start
of a run, from after each mark in it (such as ``=``, ``/``, ``_`` or ``.``) and
from where the letters change from small to capital or digits, to the run's end
or a mark. Every candidate is scored under every format, by its log likelihood
against the background. One that gains more than ``threshold`` per character and
``least_gain`` in all, and whose end the automaton accepts, becomes a span named
by its format. Of spans that overlap, the one that gains most is taken; of equal
ones the first, then the longest, then the first by name.

The default labelled credentials and the texts that are none are made by seeded
generators (``labelled_credentials``, ``labelled_others``); ``train`` takes any others.

The fixed patterns are matched first and always stay; learned spans do not
overlap them. Positions are code points, ends exclusive. Null texts are empty.
Texts of any length are handled whole; a part is given up as soon as it is much
less likely than the background, and has the length of labelled ones, so a run without spaces costs as much as its length. Rows are independent,
so repeated rows have equal results and an empty table gives an empty one.
Extra columns pass through whatever their names; ``secrets`` is replaced.
"""

from __future__ import annotations

import math
import random
import re
from base64 import b64encode, urlsafe_b64encode
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import blocks, white_space_words

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run that is long enough starts where it starts
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
KINDS = ("assign", "access", "hex")
_KEYWORDS = ("passw", "secret", "token", "api")

MARK = re.compile(r"[+/_=.~-]")
#: Where a part may start inside a run: after a mark, or where small letters end.
START = re.compile(r"(?<=[+/_=.~-])|(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z0-9])(?=[a-z])")
_GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "_", "-", "+/", "=", ".~")
#: Classes of characters: 0 is the end, 1 anything else.
CLASSES = {c: i + 2 for i, group in enumerate(_GROUPS) for c in group}
N_CLASSES = 2 + len(_GROUPS)
#: Log probability of a character in its class, all alike.
ALIKE = {c: -math.log(len(group)) for group in _GROUPS for c in group}
#: A part is given up when it is this much less likely than the background.
HOPELESS = -12.0
UNSEEN = math.log(1e-4)
#: Characters that are added to those seen in one place, in the shares of all places.
POOLED = 100

# Public formats of credentials, as (name, parts: a text that stands there, or an alphabet with the least and most length).
HEXADECIMAL = "0123456789abcdef"
DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz0123456789"
CAPITAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
URL_SAFE = ALPHANUMERIC + "-_"
FORMATS = (
    ("source_host_token", ("ghp_", (ALPHANUMERIC, 36, 36))),
    ("source_host_token", ("gho_", (ALPHANUMERIC, 36, 36))),
    ("source_host_token", ("ghs_", (ALPHANUMERIC, 36, 36))),
    ("source_host_token", ("ghu_", (ALPHANUMERIC, 36, 36))),
    ("source_host_token", ("ghr_", (ALPHANUMERIC, 36, 36))),
    ("fine_grained_token", ("github_pat_", (ALPHANUMERIC, 22, 22), "_", (ALPHANUMERIC, 59, 59))),
    ("forge_token", ("glpat-", (URL_SAFE, 20, 20))),
    ("payment_key", ("sk_live_", (ALPHANUMERIC, 24, 34))),
    ("payment_key", ("sk_test_", (ALPHANUMERIC, 24, 34))),
    ("payment_key", ("rk_live_", (ALPHANUMERIC, 24, 34))),
    ("model_key", ("sk-", (ALPHANUMERIC, 48, 48))),
    ("project_key", ("sk-proj-", (ALPHANUMERIC, 48, 48))),
    ("chat_token", ("xoxb-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (ALPHANUMERIC, 24, 24))),
    ("user_chat_token", ("xoxp-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (HEXADECIMAL, 32, 32))),
    ("chat_token", ("xoxb-", (DIGITS, 11, 13))),
    ("package_token", ("npm_", (ALPHANUMERIC, 36, 36))),
    ("index_token", ("pypi-AgEIcHlwaS5vcmc", (URL_SAFE, 70, 120))),
    ("mail_key", ("SG.", (URL_SAFE, 22, 22), ".", (URL_SAFE, 43, 43))),
    ("shop_token", ("shpat_", (HEXADECIMAL, 32, 32))),
    ("cloud_token", ("dop_v1_", (HEXADECIMAL, 64, 64))),
    ("hub_token", ("hf_", (ALPHANUMERIC, 34, 34))),
    ("web_key", ("AIza", (URL_SAFE, 35, 35))),
    ("web_token", ("eyJ", (ALPHANUMERIC, 17, 60), ".eyJ", (URL_SAFE, 20, 200), ".", (URL_SAFE, 43, 86))),
    ("secret_key", ((ALPHANUMERIC + "+/", 40, 40),)),
    ("long_project_key", ("sk-proj-", (URL_SAFE, 110, 160))),
    ("assistant_key", ("sk-ant-api03-", (URL_SAFE, 93, 93), "AA")),
    ("vault_token", ("hvs.", (ALPHANUMERIC, 24, 24))),
    ("vault_token", ("hvs.", (URL_SAFE, 90, 100))),
    ("access_token", ("ya29.", (URL_SAFE, 60, 180))),
)
#: Words of which names and prose are made that look like credentials.
WORDS = (
    "the and for with from this that have not are was all can will one about which when there their what said each other than then them these some would make like into time look two more write see number way could people over after word where most know through back much before line right too means old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask went men read need land different home us move try kind hand picture again change off play spell air away animal house point page letter mother answer found study still learn should world "
    "get user name file path value index list type data text key item count size string class model view controller service factory manager handler request response error message event state config default option parse load save create update delete find build test main util base node tree map"
).split()
PER_FORMAT = 200
#: Gain per character above which a candidate of ``scan`` is a secret.
THRESHOLD = 1.0


def labelled_credentials(per_format: int = PER_FORMAT, seed: int = 7) -> dict[str, list[str]]:
    """Credentials of each public format."""
    draw = random.Random(seed)
    say = lambda part: part if isinstance(part, str) else "".join(draw.choices(part[0], k=draw.randint(*part[1:])))
    out: dict[str, list[str]] = {}
    for name, parts in FORMATS:
        out.setdefault(name, []).extend("".join(map(say, parts)) for _ in range(per_format))
    return out


def labelled_others(count: int = 1500, seed: int = 17) -> dict[str, list[str]]:
    """Texts of credential characters that are none, by kind: names and paths of several words, and encoded prose."""
    draw = random.Random(seed)
    some = lambda low, high: draw.choices(WORDS, k=draw.randint(low, high))
    styles = (
        lambda w: w[0] + "".join(map(str.title, w[1:])), lambda w: "".join(map(str.title, w)), "_".join, "-".join, "/".join, ".".join, "".join,
        lambda w: "_".join(w).upper(), lambda w: "/".join(w[:-1]) + f"/{w[-1]}{draw.randint(0, 999)}.{draw.choice(['js', 'py', 'html', 'json'])}",
    )
    names = [draw.choice(styles)(some(3, 9)) for _ in range(count)]
    say = lambda: draw.choice([str, str.capitalize])(draw.choice([" ", " ", ", "]).join(some(4, 30)))
    encoded = [draw.choice([b64encode, urlsafe_b64encode])(say().encode()).decode().rstrip("=") for _ in range(count)]
    return {"name": names, "encoded": encoded}


class Chain:
    """Log probabilities of characters after one another, by place modulo ``period``."""

    def __init__(self, texts: list[str], period: int):
        self.period = period
        pairs = np.zeros((period, 128, 128))
        for t in texts:
            codes = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
            places = np.arange(1, len(codes)) % period
            np.add.at(pairs, (places, codes[:-1], codes[1:]), 1)
        known = np.zeros(128)
        known[[ord(c) for c in CLASSES]] = 1
        alone = pairs.sum(1) + 0.5 * known
        alone /= alone.sum(1, keepdims=True)
        mixed = (pairs + 8 * alone[:, None, :]) / (pairs.sum(2, keepdims=True) + 8)
        self.table = np.log(np.maximum(mixed, 1e-9)).tolist()

    def sums(self, text: str) -> list[list[float]]:
        """Up to each place, one list for each alignment."""
        codes = [min(ord(c), 127) for c in text]
        out = []
        for shift in range(self.period):
            total, before = [0.0], codes[0] if codes else 0
            for i, c in enumerate(codes):
                total.append(total[-1] + self.table[(i + shift) % self.period][before][c])
                before = c
            out.append(total)
        return out


PERIODS = {"encoded": 4}


def _classes(text: str) -> list[int]:
    return [CLASSES.get(c, 1) for c in text]


class Automaton:
    """A probabilistic automaton: next state and log probability by state and character."""

    def __init__(self, credentials: list[str], alpha: float = 0.01):
        #: marks that part the credentials; other characters are the class "" in the tree
        self.marks = frozenset(c for c in "+/_=.~-" if len(times := {t.count(c) for t in credentials}) <= 2 and times != {0})
        #: a node is [ends, {class: [node, count, {character: count}, counts of digits, small and capital letters]}]
        root: list = [0, {}]
        for text in sorted(credentials):
            node = root
            for c in text:
                step = node[1].setdefault(c if c in self.marks else "", [[0, {}], 0, {}, [0, 0, 0]])
                step[1] += 1
                for i, is_kind in enumerate((c.isdigit(), c.islower(), c.isupper())):
                    step[3][i] += is_kind
                step[2][c] = step[2].get(c, 0) + 1
                node = step[0]
            node[0] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [root]
        known = {id(root)}
        blue = [(root, k) for k in sorted(root[1])]
        while blue:
            parent, k = blue.pop(0)
            node = parent[1][k][0]
            if id(node) in known:
                continue
            like = [r for r in red[1:] if self._literal(r) == self._literal(node) and self._compatible(r, node)]
            if like:
                r = min(like, key=lambda r, node=node: self._distance(r, node))
                parent[1][k][0] = r
                self._fold(r, node)
            else:
                red.append(node)
                known.add(id(node))
            blue = [(r, j) for r in red for j in sorted(r[1]) if id(r[1][j][0]) not in known]
        number = {id(r): i for i, r in enumerate(red)}
        self.end = [math.log(r[0] / self._total(r)) if r[0] else -math.inf for r in red]
        pool: dict[str, int] = {}  # what is seen where no one character stands
        for r in red:
            for _, _, seen, _ in r[1].values():
                for c, n in seen.items() if len(seen) > 1 else ():
                    pool[c] = pool.get(c, 0) + n
        every = sum(pool.values()) or 1
        #: {class: (next state, log probability of the class, {character: log probability in the class}, that of others)}
        self.steps: list[dict[str, tuple[int, float, dict[str, float], float]]] = []
        for r in red:
            total, own = self._total(r), {}
            for k, (to, n, seen, _) in r[1].items():
                if len(seen) == 1:  # as much as one character in a hundred is left to those not seen
                    told, other = {c: math.log(x / (1.01 * n)) for c, x in seen.items()}, math.log(0.01 / (1.01 * 64))
                else:  # few were seen in one place, so what is seen in all of them counts as POOLED more
                    whole = 1.01 * (n + POOLED)
                    told = {c: math.log((seen.get(c, 0) + POOLED * x / every) / whole) for c, x in pool.items()}
                    other = math.log(0.01 / (1.01 * 64))
                own[k] = (number[id(to)], math.log(n / total), told, other)
            self.steps.append(own)

    @staticmethod
    def _total(node: list) -> int:
        return node[0] + sum(step[1] for step in node[1].values())

    @staticmethod
    def _literal(node: list) -> str:
        """The one character that always follows a state, if there is one and the state was met more than a few times."""
        (step,) = node[1].values() if len(node[1]) == 1 and not node[0] else (None,)
        return next(iter(step[2])) if step and step[1] > 20 and len(step[2]) == 1 else ""

    def _distance(self, a: list, b: list) -> float:
        """How far the frequencies of two states are apart; of equal ones the first is taken."""
        n, m = self._total(a) or 1, self._total(b) or 1
        share = lambda x, k, t: x[1][k][1] / t if k in x[1] else 0.0
        return abs(a[0] / n - b[0] / m) + sum(abs(share(a, k, n) - share(b, k, m)) for k in a[1].keys() | b[1].keys())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: list, b: list) -> bool:
        """No frequency of the two states, or of those that follow, differs by more than the bound."""
        stack, met = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if (id(a), id(b)) in met:
                continue
            met.add((id(a), id(b)))
            n, m = self._total(a), self._total(b)
            if not n or not m or self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
                continue  # too few to differ, and fewer still behind them
            if self._differ(a[0], n, b[0], m):
                return False
            for k in a[1].keys() | b[1].keys():
                x, y = a[1].get(k), b[1].get(k)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    if any(self._differ(i, x[1], j, y[1]) for i, j in zip(x[3], y[3], strict=True)):
                        return False
                    stack.append((x[0], y[0]))
        return True

    @staticmethod
    def _fold(a: list, b: list) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            a[0] += b[0]
            for k, (to, n, seen, kinds) in b[1].items():
                if k in a[1]:
                    own = a[1][k]
                    own[1] += n
                    own[3] = [i + j for i, j in zip(own[3], kinds, strict=True)]
                    for c, x in seen.items():
                        own[2][c] = own[2].get(c, 0) + x
                    stack.append((own[0], to))
                else:
                    a[1][k] = [to, n, seen, kinds]


class Model:
    """Automata by format, the log probabilities of class pairs in the background, and chains of texts that are none."""

    def __init__(self, automata: dict[str, Automaton], pairs: np.ndarray, threshold: float, least_gain: float, lengths: dict[str, tuple[int, int]], others: dict[str, list[str]]):
        self.automata, self.threshold, self.least_gain, self.lengths = automata, threshold, least_gain, lengths
        smooth = pairs.reshape(N_CLASSES, N_CLASSES) + 1.0
        self.background = np.log(smooth / smooth.sum(1, keepdims=True)).tolist()
        self.chains = [Chain(texts, PERIODS.get(kind, 1)) for kind, texts in others.items() if texts]
        #: formats by the characters with which they may begin
        self.first: dict[str, list[str]] = {}
        for name, automaton in automata.items():
            for c in {c for _, _, seen, _ in automaton.steps[0].values() for c in seen}:
                self.first.setdefault(c, []).append(name)

    def gains(self, text: str, classes: list[int], base: list[float], start: int, name: str, ends: set[int]) -> Iterator[tuple[int, float]]:
        """(end, gain) of the parts from a start that a format accepts and whose length it has; ``base`` is the background up to each place."""
        automaton, (least, most) = self.automata[name], self.lengths[name]
        state, total, before = 0, 0.0, base[start] - (self.background[0][classes[start]] - self.background[classes[start - 1] if start else 0][classes[start]])
        for end in range(start + 1, min(start + most, len(text)) + 1):
            c = text[end - 1]
            step = automaton.steps[state].get(c if c in automaton.marks else "")
            if step is None:
                return
            state, of_class, seen, other = step
            total += of_class + seen.get(c, other)
            gain = total - (base[end] - before)
            if gain < HOPELESS:
                return
            if end in ends and end - start >= least and automaton.end[state] > UNSEEN:
                yield end, gain + automaton.end[state] - self.background[classes[end - 1]][0]

    def parts(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, format, gain) of the parts of a run that an automaton accepts."""
        classes, base = _classes(text), [0.0]
        for i, k in enumerate(classes):
            base.append(base[-1] + self.background[classes[i - 1] if i else 0][k] + ALIKE.get(text[i], -4.0))
        sums: list[list[float]] | None = None
        marks = [m.start() for m in MARK.finditer(text)]
        ends = {*marks, *(k + 1 for k in marks), len(text)}
        in_order = sorted(ends)
        starts = sorted({0, *(m.start() for m in START.finditer(text))} - {len(text)})
        for start in starts:
            for name in self.first.get(text[start], ()):
                least, most = self.lengths[name]
                at = bisect_left(in_order, start + least)
                if at == len(in_order) or in_order[at] > start + most:
                    continue
                for end, gain in self.gains(text, classes, base, start, name, ends):
                    if gain <= self.threshold * (end - start) or gain <= self.least_gain:
                        continue
                    if sums is None:
                        sums = [x for chain in self.chains for x in chain.sums(text)]
                    told = base[end] - base[start]
                    gain -= max([x[end] - x[start] for x in sums] + [told]) - told  # the likeliest background counts
                    if gain > self.threshold * (end - start) and gain > self.least_gain:
                        yield start, end, name, gain

    def best(self, text: str) -> tuple[str, float]:
        """The likeliest format of a whole text and its gain over the background."""
        found = [(-gain, name) for start, end, name, gain in self.parts(text) if start == 0 and end == len(text)]
        return (min(found)[1], -min(found)[0]) if found else ("", -math.inf)


def train(credentials: dict[str, list[str]], pairs: np.ndarray, *, alpha: float = 0.01, threshold: float = 0.5, least_gain: float = 20.0, others: dict[str, list[str]] | None = None) -> Model:
    """A model from labelled credentials of each format, counts of background class pairs, and texts that are none by kind."""
    some = {k: v for k, v in credentials.items() if v}
    sizes = {k: (min(map(len, v)), max(map(len, v))) for k, v in some.items()}
    # a format of no fixed length may be a quarter of its spread shorter or longer than was seen
    lengths = {k: (a - (b - a) // 4, b + (b - a) // 4) for k, (a, b) in sizes.items()}
    return Model({k: Automaton(v, alpha) for k, v in some.items()}, pairs, threshold, least_gain, lengths, labelled_others() if others is None else others)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.ones(256, np.int64)
    for c, k in CLASSES.items():
        table[ord(c)] = k
    total = np.zeros(N_CLASSES * N_CLASSES, np.int64)
    for batch in batches:
        for block in blocks(batch.column(0), white_space_words()):
            if not len(block.start):
                continue
            c = np.where(white_space_words()[block.data], table[block.data], 0)
            total += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])


def background(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Counts of character class pairs in all documents' words; a table of fixed size."""
    rows = docs.select(text).mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N_CLASSES * N_CLASSES)
    for r in rows:
        out[r.pair] = r.n
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end, kind) of the fixed patterns, in order."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def learned_spans(text: str, base: list[tuple], model: Model) -> list[tuple[int, int, int, str]]:
    """Candidates that a learned format explains, away from the fixed patterns."""
    found: list[tuple[int, int, int, str]] = []
    starts = [x for x, _, _, _ in base]
    reach = [0, *accumulate((y for _, _, y, _ in base), max)]  # how far the spans up to each one reach
    for m in CANDIDATE.finditer(text):
        parts = []
        for start, end, name, gain in model.parts(m[0]):
            a, b = m.start() + start, m.start() + end
            if reach[bisect_left(starts, b)] <= a:
                parts.append((-gain, a, -b, name))
        taken: list[tuple[int, int, int, str]] = []
        for _, a, b, name in sorted(parts):
            i = bisect_left(taken, (-b,))
            if not i or taken[i - 1][2] <= a:
                taken.insert(i, (a, 3, -b, name))
        found += taken
    return found


def _scan(model: Model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("learned", pa.bool_())]))
        for batch in batches:
            out = []
            for value in batch.column(text):
                t = value.as_py() or ""
                base = base_spans(t)
                out.append([{"kind": k, "start": a, "end": b, "learned": o == 3} for a, o, b, k in sorted(base + learned_spans(t, base, model))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], names=[*keep, "secrets"])

    return run


def scan(docs: DataFrame, model: Model | None = None, *, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with secrets: (kind, start, end, learned) by start, then kind."""
    model = model or train(labelled_credentials(), background(docs, text=text), threshold=THRESHOLD)
    keep = [c for c in docs.columns if c not in (text, "secrets")]
    secret = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("learned", "boolean")
    schema = T.StructType([docs.schema[c] for c in keep]).add("secrets", T.ArrayType(secret))
    return docs.select(*keep, text).mapInArrow(_scan(model, text, keep), schema)
