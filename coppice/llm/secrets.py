"""Secret scan by grammar inference.

Fixed patterns find assignments, access keys and hexadecimal runs. Their values are the labelled credentials: per kind
a prefix tree of symbol classes is folded into a probabilistic automaton by merging states whose outgoing frequencies
a Hoeffding bound cannot tell apart. Every other candidate run of the texts is then scored by the automata; it is a
finding when its likelihood per symbol is typical of the credentials of a kind and well above that of ordinary runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, only, written

#: Fixed patterns, in the order that decides between findings with the same start.
KINDS = ["assign", "access", "hex", "inferred"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Credentials and ordinary runs an automaton learns from (bounded samples by hash), and the merge confidence.
SAMPLE, ALPHA = 2000, 0.05
#: Bits per symbol by which a credential's automaton must beat the ordinary one.
MARGIN = 0.5
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def base_findings(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns, in code points, by start and kind."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: Sequence[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Other runs of credential symbols that hold both letters and digits."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not run.isalpha() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            if not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
                found.append((m.start(), 3, m.end(), run))
    return found


_CLASS = {ord(c): s for chars, s in (("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"), ("GHIJKLMNOPQRSTUVWXYZ", "U"), ("0123456789", "d")) for c in chars}


def classes(value: str) -> str:
    """Symbols as classes: hexadecimal and other letters by case, digits; punctuation stays itself."""
    return value.translate(_CLASS)


class Automaton:
    """Probabilistic automaton learned from strings by merging compatible prefix-tree states (ALERGIA)."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA):
        self.total: list[int] = [0]
        self.ends: list[int] = [0]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.alpha = alpha
        for s in sorted(strings):
            self._insert(s)
        self._merge_all()

    def _insert(self, s: str) -> None:
        state = 0
        self.total[0] += 1
        for c in s:
            target, count = self.arcs[state].get(c, (len(self.total), 0))
            if not count:
                self.total.append(0)
                self.ends.append(0)
                self.arcs.append({})
            self.arcs[state][c] = (target, count + 1)
            state = target
            self.total[state] += 1
        self.ends[state] += 1

    def _close(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) < bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.total[a], self.total[b]
            if not n1 or not n2:
                continue
            if not self._close(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                one, two = self.arcs[a].get(c, (None, 0)), self.arcs[b].get(c, (None, 0))
                if not self._close(one[1], n1, two[1], n2):
                    return False
                if one[1] and two[1]:
                    todo.append((one[0], two[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, (target, count) in self.arcs[b].items():
                if c in self.arcs[a]:
                    own, old = self.arcs[a][c]
                    self.arcs[a][c] = (own, old + count)
                    todo.append((own, target))
                else:
                    self.arcs[a][c] = (target, count)

    def _merge_all(self) -> None:
        kept, order = [0], [(0, c) for c in sorted(self.arcs[0])]
        while order:
            parent, c = order.pop(0)
            state, count = self.arcs[parent][c]
            if state in kept:
                continue
            for other in kept:
                if self._compatible(other, state):
                    self.arcs[parent][c] = (other, count)
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
            order = [(p, s) for p in kept for s in sorted(self.arcs[p]) if self.arcs[p][s][0] not in kept]
        self.states = kept

    def bits(self, s: str, symbols: int = 12) -> float:
        """Mean log2 probability per symbol, the end counted as one; unseen moves have half a count."""
        state, total = 0, 0.0
        for c in s:
            target, count = self.arcs[state].get(c, (state, 0))
            total += math.log2((count + 0.5 / symbols) / (self.total[state] + 1))
            state = target
        return (total + math.log2((self.ends[state] + 0.5 / symbols) / (self.total[state] + 1))) / (len(s) + 1)


class FormatModel:
    """Automata of the credential kinds and of ordinary runs, with the range of likelihoods typical of each kind."""

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str], margin: float = MARGIN):
        self.margin = margin
        self.ordinary = Automaton([classes(v) for v in ordinary])
        self.kinds: list[tuple[int, Automaton, float, float, int]] = []
        for kind, values in sorted(labelled.items()):
            if len(values) >= 20:
                learned = Automaton([classes(v) for i, v in enumerate(values) if i % 4])
                typical = sorted(learned.bits(classes(v)) for i, v in enumerate(values) if i % 4 == 0)
                self.kinds.append((kind, learned, typical[len(typical) // 50], typical[-1], min(map(len, values))))

    def score(self, value: str) -> tuple[float, bool]:
        """Best gain in bits per symbol over ordinary runs, and whether the value is a finding."""
        s = classes(value)
        plain, best, hit = self.ordinary.bits(s), -math.inf, False
        for _, learned, low, high, shortest in self.kinds:
            bits = learned.bits(s)
            best = max(best, bits - plain)
            hit |= len(value) >= shortest and low <= bits <= high and bits - plain >= self.margin
        return best, hit


def extract(df: DataFrame, text: str) -> DataFrame:
    """Adds ``found`` (base findings) and ``rest`` (other candidates); the text itself is dropped."""

    @F.pandas_udf(f"found array<{SPAN}>, rest array<{SPAN}>, ordinary array<string>")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for value in texts:
                value = value or ""
                base = base_findings(value)
                named = [[dict(zip(("start", "kind", "stop", "value"), f, strict=True)) for f in part] for part in (base, candidates(value, base))]
                run = CANDIDATE.search(value)  # one ordinary run a text is plenty to learn from
                rows.append((*named, [run.group()] if run and run.group().isalpha() else []))
            yield pd.DataFrame(rows, columns=["found", "rest", "ordinary"])

    name = free_name(df, "scan")
    return df.withColumn(name, find(F.col(text))).select(*[c for c in df.columns if c != text], f"{name}.*")


def learn(scanned: DataFrame, sample: int = SAMPLE) -> FormatModel:
    """Automata from at most ``sample`` distinct values a kind, those with the lowest hashes."""
    def lowest(values: DataFrame) -> list[str]:
        return [r.v for r in values.distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()]

    values = scanned.select(F.explode("found").alias("f")).select("f.kind", F.col("f.value").alias("v")).where(F.length("v") <= 200)
    labelled = {kind: lowest(values.where(F.col("kind") == kind).select("v")) for kind in range(3)}
    return FormatModel(labelled, lowest(scanned.select(F.explode("ordinary").alias("v")).where(F.length("v") <= 200)))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", model: FormatModel | None = None) -> DataFrame:
    """Per row: key, ``base`` and ``inferred`` findings, arrays of (start, kind, stop, value) in code points.

    Null text is empty; repeated rows are scanned each; other columns are ignored. With fewer than 20 labelled values
    of a kind no automaton of that kind is learned. An empty table gives no rows.
    """
    named = only(df, key, text).toDF("id", "body")
    scanned = written(extract(named, "body"), "secrets")
    shared = df.sparkSession.sparkContext.broadcast(model or learn(scanned))

    @F.pandas_udf("array<boolean>")
    def verdicts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in series:
            yield pd.Series([[shared.value.score(v)[1] for v in values] for values in lists])

    judged = scanned.withColumn("ok", verdicts(F.transform("rest", lambda r: r["value"])))
    hits = F.transform(F.filter(F.arrays_zip("rest", "ok"), lambda z: z["ok"]), lambda z: z["rest"])
    return judged.select(F.col("id").alias(key), F.col("found").alias("base"), hits.alias("inferred"))
