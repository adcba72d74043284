"""Personal data by candidate generation and boosted trees (operator 1).

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay.  Wider generators propose further,
overlapping spans: written-out addresses, bracketed dots, other separators, numbers without a plus.  Boosted trees judge each
by its format (digits, separators, check digit, parts) and its context (neighbouring characters and words); a
threshold per kind, set on held-out candidates for PRECISION, selects what is added; kinds with few held-out positives take the threshold
of all kinds.  A run of number groups is proposed from every group on, to every group that gives a possible count of digits.

The trees and thresholds come from every candidate of every document: base spans are positive, also
in other ways of writing them; candidates that fail the checks, and other writings made to fail them, are negative.

Scale: maps over documents; text is read in linear time (no pattern is retried inside a long run).  Equal examples are counted where they
are found and once more by a shuffle; up to IN_MEMORY different ones are learned from in memory, more by a pass over their table for each
level of a tree.  The driver sees sums per (node, feature, bin) and counts per margin only, or those examples in memory.

Defined cases: null text counts as empty and has no spans; identifiers are carried along only, nulls too; repeated rows are judged each; without candidates, or with one class only, nothing is added; columns beside identifier and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BINS, Boosted, Tree, binned, fit, level_sums, on_values, sums_of
from tidemark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
WRITTEN = ("email", "ip")  # kinds whose candidates are never parts of one another
IN_MEMORY = 100_000  # different examples (some 40 bytes each) that are learned from without passes over a table
FLUSH = 50_000  # different examples that a task counts before it hands them on
FOLDS = 3
PRECISION = 0.98
MOST_EXAMPLES = 500
WRITINGS = 2  # other writings of a base span that are learned from
LEAST_POSITIVES = 20  # held-out positives a kind needs for a threshold of its own
CONTEXT = 40

DIGIT = re.compile(r"[0-9]")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider generators.
AT = re.compile(r"[\x20]?(?:\(at\)|\[at\]|\{at\}|＠)[\x20]?|\x20at\x20", re.I)
WIDE_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\])[\x20]?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
WIDE_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20dot\x20|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9])")
WIDE_NUMBER = re.compile(r"(?:\+|(?<![0-9]))[(]?[0-9](?:[\x20()./_  ‐‑–-]{0,2}[0-9])+")
GROUP = re.compile(r"[0-9]+")
LEAST_DIGITS, MOST_DIGITS = 7, 19
NEAR_WORDS = (("mail", "contact", "write", "reach"), ("host", "server", "address", "ip", "from"), ("card", "visa", "pay", "credit", "account"),
              ("phone", "call", "tel", "mobile", "fax"), ("version", "license", "isbn", "page", "token", "key"))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, read outward from every @, so a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def _quads(text: str) -> Iterator[tuple[int, int]]:
    """Fours of numbers in a dotted run, from its left."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            size = len(".".join(parts[i:i + 4]))
            if all(int(p[-10:]) <= 255 and not p[:-10].strip("0") for p in parts[i:i + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", a, b) for a, b in _quads(text)]
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _runs(text: str, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Digits, begin and end of every row of neighbouring groups with a possible count of digits: at most 19 for each first group."""
    groups = [g.span() for g in GROUP.finditer(text, start, stop)]
    for i, (a, _) in enumerate(groups):
        a = start if i == 0 else a - (text[a - 1] == "(")
        n = 0
        for begin, end in groups[i:i + MOST_DIGITS]:
            n += end - begin
            if n > MOST_DIGITS:
                break
            if n >= LEAST_DIGITS:
                yield n, a, end


def candidates(text: str) -> list[Span]:
    """Proposals of the wider generators; they may overlap each other and base spans."""
    found = []
    for m in AT.finditer(text):
        left = m.start()
        while left and text[left - 1] in LOCAL:
            left -= 1
        right = WIDE_HOST.match(text, m.end())
        if left < m.start() and right:
            found.append(("email", left, right.end()))
    if DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in WIDE_QUAD.finditer(text)]
        for m in WIDE_NUMBER.finditer(text):
            for n, a, b in _runs(text, m.start(), m.end()):
                if 12 <= n:
                    found.append(("card", a, b))
                if n <= 15:
                    found.append(("phone", a, b))
    return found


def _char(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    body, digits = text[a:b], _digits(text[a:b])
    before, after = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    near = (before + " " + after).lower()
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    parts = re.split(r"[^0-9]+", body)
    host = re.split(r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\x20dot\x20|\.)\x20?", body, flags=re.I)
    others = [c for c in body if not c.isalnum()]
    return [
        KINDS.index(kind), len(body), len(digits), len(others), len(set(others)), float(luhn(digits)) if digits else 0.0,
        len(groups), *(groups[:1] or [0]), *(groups[-1:] or [0]), max(groups, default=0), min(groups, default=0), max((int(p[-6:]) for p in parts if p), default=0),
        float(digits[:1] or -1), float("(" in body), float("+" in body), float("." in body), float("/" in body or "_" in body),
        float("dot" in body.lower()), float(bool(re.search(r"[\[({]at[\])}]|＠", body, re.I))), len(host), len(host[-1]),
        _char(before[-1:]), _char(after[:1]), float(_digits(before[-3:]) != ""), float(_digits(after[:3]) != ""), sum(c.isdigit() for c in near), *(float(any(w in near for w in words)) for words in NEAR_WORDS),
    ]


def rewritten(kind: str, body: str, pick: int) -> tuple[str, str]:
    """Another way of writing a base span, and one like it that fails the checks (the same again where none is made)."""
    digits = _digits(body)
    if kind == "email":
        at = (" at ", " (at) ", "[at]", " [at] ")[pick % 4]
        dot = (" dot ", "[dot]", " (dot) ", ".")[pick // 4 % 4]
        return body.replace("@", at).replace(".", dot) if dot != "." else body.replace("@", at), body.partition("@")[0] + " at " + body.rpartition(".")[2]
    if kind == "ip":
        sep = ("[.]", "(.)", " dot ", " . ")[pick % 4]
        parts = body.split(".")
        return sep.join(parts), sep.join([*parts[:3], str(300 + pick % 600)])
    if kind == "card":
        sep = (".", "/", "_", " ", "–")[pick % 5]
        cut = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick % 8) % 10)
        return sep.join(cut), sep.join(wrong[i:i + 4] for i in range(0, len(wrong), 4))
    area, rest = digits[-10:-7], digits[-7:]
    ways = (f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"00{digits}")
    return ways[pick % 4], (f"{digits[-4:]}-{digits[-6:-4]}-{digits[-2:]}", f"{rest[:3]}.{rest[3:5]}.{rest[5:]}")[pick % 2]


def beside(kind: str, body: str, pick: int) -> str:
    """What may stand next to a number: another phone in the same writing, or the end of a card's time."""
    if kind == "card":
        return (" ", "  ")[pick % 2] + f"{pick // 2 % 12 + 1:02d}/{20 + pick // 24 % 15}"
    return (" ", " / ", "/")[pick % 3] + "".join(str((int(c) * 3 + 7) % 10) if "0" <= c <= "9" else c for c in body)


def examples(ident: int | None, text: str) -> Iterator[tuple[int, list[float], int]]:
    """(kind, features, label) of a document's candidates and of other writings of its base spans."""
    base = base_spans(text)
    numbers = {(k, _digits(text[a:b])) for k, a, b in base}
    for span in [*base, *candidates(text)]:
        over = any(k == span[0] and a < span[2] and span[1] < b for k, a, b in base)
        # Parts of a base number are never judged, as base spans stay; other writings below teach what a part is.
        if not over or span[0] in WRITTEN or (span[0], _digits(text[span[1]:span[2]])) in numbers:
            yield KINDS.index(span[0]), features(text, span), int(over)
    for kind, a, b in base:
        digest = hashlib.md5(f"{ident}:{a}".encode()).digest()
        for pick in (int.from_bytes(digest[i:i + 4], "big") for i in range(0, 4 * WRITINGS, 4)):
            right, wrong = rewritten(kind, text[a:b], pick)
            for label, body, next_to in ((1, right, ""), (0, wrong, ""), *(() if kind in WRITTEN else ((1, right, beside(kind, right, pick)),))):
                inner = body + next_to
                changed = text[max(0, a - 2 * CONTEXT):a] + inner + text[b:b + 2 * CONTEXT]
                at = min(a, 2 * CONTEXT)
                wanted = {_digits(body), _digits(next_to)} if kind == "phone" else {_digits(body)}
                for span in candidates(changed):
                    if span[1] < at + len(inner) and at < span[2] and (label == 0 or span[0] == kind or next_to):
                        # Part of a number, or one with its neighbour, is none.
                        whole = kind in WRITTEN or _digits(changed[span[1]:span[2]]) in wanted
                        yield KINDS.index(span[0]), features(changed, span), int(label and whole and span[0] == kind)


@dataclass(frozen=True)
class Model:
    trees: Boosted | None
    cut: tuple[float, ...]  # margin from which a kind's candidates are added

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates that pass, clear of base spans and of better candidates."""
        if not self.trees:
            return []
        used = bytearray(len(text))
        for _, a, b in base:
            used[a:b] = b"\1" * (b - a)
        found = [c for c in candidates(text) if used.find(1, c[1], c[2]) < 0]
        if not found:
            return []
        margin = self.trees.margin(np.array([features(text, c) for c in found]))
        taken: list[Span] = []
        for i in np.argsort(-margin, kind="stable").tolist():
            kind, a, b = found[i]
            if margin[i] >= self.cut[KINDS.index(kind)] and used.find(1, a, b) < 0:
                taken.append(found[i])
                used[a:b] = b"\1" * (b - a)
        return taken


def _cut(margin: np.ndarray, label: np.ndarray, n: np.ndarray | None = None) -> float:
    """Lowest margin above which held-out precision stays at PRECISION; infinite if there are too few positives.  `n` counts equal rows."""
    n = np.ones(len(margin)) if n is None else n
    if (n * label).sum() < LEAST_POSITIVES:
        return float("inf")
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum((n * label)[order]) / np.cumsum(n[order])
    # Equal margins stand or fall together.
    last = np.append(np.diff(margin[order]) != 0, True)
    good = np.flatnonzero((right >= PRECISION) & last)
    return max(0.0, float(margin[order][good[-1]])) if len(good) else float("inf")


def _cuts(kind: np.ndarray, margin: np.ndarray, label: np.ndarray, n: np.ndarray | None = None) -> tuple[float, ...]:
    """Threshold of every kind; that of all kinds together for a kind with few positives."""
    n = np.ones(len(margin)) if n is None else n
    own = [kind == k for k in range(len(KINDS))]
    return tuple(_cut(margin[k], label[k], n[k]) if (n * label)[k].sum() >= LEAST_POSITIVES else _cut(margin, label, n) for k in own)


def few(found: list[tuple[int, list[float], int]], ident: int) -> list[tuple[int, list[float], int]]:
    """At most MOST_EXAMPLES of a document's examples, spread over it."""
    if len(found) <= MOST_EXAMPLES:
        return found
    step = len(found) / MOST_EXAMPLES
    return [found[int(i * step) + ident % int(step)] for i in range(MOST_EXAMPLES)]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and counts of a batch of examples (x, y, n)."""
    x = batch.column("x").to_pylist()
    return (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1), batch.column("y").to_numpy().astype(float), batch.column("n").to_numpy().astype(np.int64))


def counted_examples(docs: DataFrame, text: str = "text", sample_docs: int | None = None) -> DataFrame:
    """(held_out, x, y, n): how often each example, in bins, occurs in the documents; equal texts stand on one side."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bool, bytes, int], int] = {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.binary()),
                                              pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["held_out", "x", "y", "n"])
            seen.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) % FOLDS == 0
                found = examples(i, t.as_py() or "")
                for _, x, y in found if sample_docs is None else few(list(found), i):
                    key = held, binned(np.array(x)).tobytes(), y
                    seen[key] = seen.get(key, 0) + 1
                    if len(seen) >= FLUSH:
                        yield flush()
        if seen:
            yield flush()

    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    chosen = docs.select(digest.alias("id"), F.col(text).alias("text"))
    if sample_docs is not None:  # equal texts have one digest, so they are learned from once
        part = min(1.0, sample_docs / max(1, docs.count()))
        chosen = chosen.where((F.lit(part) >= 1) | (F.col("id").bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(int(part * (1 << 62)))))
        chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))
    found = chosen.mapInArrow(run, "held_out boolean, x binary, y int, n bigint")
    return found.groupBy("held_out", "x", "y").agg(F.sum("n").alias("n"))


def _table_sums(rows: DataFrame, features: int) -> Callable[[Boosted, Tree, int], np.ndarray]:
    """`level_sums` over a table of examples: each task adds up its rows, tasks are added in a tree."""
    def sums(model: Boosted, begun: Tree, level: int) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, (1 << level) * features * BINS), np.int64)
            for batch in batches:
                if batch.num_rows:
                    bins, y, n = _arrays(batch)
                    out += level_sums(bins, y, n, model.margin(bins), begun, level)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
        return parts.treeReduce(np.add).reshape(2, -1)

    return sums


def _margins(bins: np.ndarray, y: np.ndarray, n: np.ndarray, trees: Boosted) -> tuple[np.ndarray, ...]:
    """Kind, margin in thousandths, label and count; the kind is the first feature."""
    kind = np.searchsorted(binned(np.arange(len(KINDS))), bins[:, 0])
    return kind.astype(np.int64), np.rint(trees.margin(bins) * 1000).astype(np.int64), y.astype(np.int64), n


def learn(docs: DataFrame, text: str = "text", sample_docs: int | None = None) -> Model:
    """Trees and thresholds from all documents (`sample_docs`: from about so many)."""
    table = cut_lineage(counted_examples(docs, text, sample_docs))
    counts = {(r["held_out"], r["y"]): (r["n"], r["rows"]) for r in table.groupBy("held_out", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    total, positive = (sum(counts.get((False, y), (0,))[0] for y in ys) for ys in ((0, 1), (1,)))
    if sum(n for n, _ in counts.values()) < 2 * LEAST_POSITIVES or not 0 < positive < total:
        return Model(None, (float("inf"),) * len(KINDS))
    features = len(table.select("x").first()[0])
    train, test = table.where(~F.col("held_out")), table.where("held_out")
    if sum(rows for _, rows in counts.values()) <= IN_MEMORY:
        here = [_arrays(pa.RecordBatch.from_pandas(part.select("x", "y", "n").toPandas())) if counts.keys() & {(held, 0), (held, 1)} else None
                for held, part in ((False, train), (True, test))]
        trees = fit(total, positive, features, sums_of(*here[0]))
        found = np.stack(_margins(*here[1], trees)) if here[1] else np.zeros((4, 0), np.int64)
    else:
        trees = fit(total, positive, features, _table_sums(train, features))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _margins(*_arrays(batch), trees)], names=["kind", "margin", "y", "n"])

        cells = test.mapInArrow(run, "kind bigint, margin bigint, y bigint, n bigint").groupBy("kind", "margin", "y").agg(F.sum("n").alias("n"))
        found = np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4).T
    kind, margin, label, n = found
    return Model(on_values(trees), _cuts(kind, margin / 1000, label, n))


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find_spans(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = [[], [], [], []], [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                base = base_spans(value)
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join([*base, *model.added(value, base)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The same rows with every span in `text` replaced by its kind in angle brackets."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at).to_pylist():
                if value:
                    base = base_spans(value)
                    done = len(value)
                    for kind, a, b in sorted([*base, *model.added(value, base)], key=lambda s: -s[1]):
                        if b <= done:
                            value, done = f"{value[:a]}<{kind}>{value[b:]}", a
                out.append(value)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
