"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols of a small alphabet (insult, threat, target, negation,
reported speech, other). Three transducers, one for the scope of negation, one for
reported speech and one that pairs insults and threats with a target, are composed
into one table. It runs over each clause and says what the clause is: nothing, an
insult, an insult of a target, a threat, a negated or a reported one. Only matched
clauses score; a word outside a pattern does not.

Targets, negations, verbs of saying and of violence are fixed words. The insults
are learned: word beginnings of 4 to 7 bytes that occur in at least ``SUPPORT`` toxic
documents and ``ODDS`` times as often there as in clean ones. Insults and the weights
of the clause kinds (a logistic fit) come from about ``SAMPLE`` labelled rows, chosen
by a hash of the id; that bound is the only limit, all texts are scored whole.

Null and empty texts have no clause and get the score of a text without matches.
Rows with a null id are scored and teach nothing, since labels refer to ids; of
several labels of an id the highest counts. Without labels of both kinds no insult
is known and the score is the share of toxic labels, 0 without any. Repeated rows
are scored alike. Further columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C

SAMPLE, SUPPORT, ODDS, LEXICON, PREFIXES = 20_000, 8, 20.0, 5_000, (4, 5, 6, 7)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
#: Words of the closed classes, in English, German, French and Spanish.
CLOSED = {
    THREAT: "kill hurt destroy murder beat stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u they them he she him du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never none nor neither nicht kein keine nie niemals pas jamais aucun ni nunca jamás tampoco",
    REPORT: "said says wrote quoted reported claimed called sagte sagt schrieb zitierte dit écrit cité dijo dice escribió citó",
}
#: How many words a negation reaches.
REACH = 3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".!?;:,\n"]] = True

# A transducer is (next state, output): two arrays [state, symbol].
#: What a clause says of each insult or threat, and its place in the counts.
KINDS = ("insult", "aimed insult", "threat", "aimed threat", "negated", "reported")


def negation() -> tuple[np.ndarray, np.ndarray]:
    """State: words that a negation still reaches. Insults and threats in reach become negations."""
    goes, says = np.zeros((REACH + 1, 7), np.int64), np.tile(np.arange(7), (REACH + 1, 1))
    for left in range(REACH + 1):
        goes[left] = max(0, left - 1)
        goes[left, NEGATION], goes[left, BREAK] = REACH, 0
        says[left, NEGATION] = OTHER
        if left:
            says[left, [INSULT, THREAT]] = NEGATION
    return goes, says


def reporting() -> tuple[np.ndarray, np.ndarray]:
    """State: a verb of saying stands before. Insults and threats after it are reports."""
    goes = np.array([[0, 0, 0, 0, 0, 1, 0], [1, 1, 1, 1, 1, 1, 0]])
    says = np.tile(np.arange(7), (2, 1))
    says[:, REPORT] = OTHER
    says[1, [INSULT, THREAT]] = REPORT
    return goes, says


def aiming() -> tuple[np.ndarray, np.ndarray]:
    """State: a target stands before. Says the kind of each match, counted from 1; else 0."""
    goes = np.array([[0, 0, 0, 1, 0, 0, 0], [1, 1, 1, 1, 1, 1, 0]])
    says = np.zeros((2, 7), np.int64)
    says[:, NEGATION], says[:, REPORT] = 5, 6
    says[0, [INSULT, THREAT]] = 1, 3
    says[1, [INSULT, THREAT]] = 2, 4
    return goes, says


def compose(first, second) -> tuple[np.ndarray, np.ndarray]:
    """The transducer that reads what ``first`` reads and says what ``second`` makes of it."""
    (goes_a, says_a), (goes_b, says_b) = first, second
    n = len(goes_b)
    goes = goes_a[:, None, :] * n + goes_b[:, says_a].transpose(1, 0, 2)
    return goes.reshape(-1, goes_a.shape[1]), says_b[:, says_a].transpose(1, 0, 2).reshape(-1, goes_a.shape[1])


GRAMMAR = compose(compose(negation(), reporting()), aiming())


def spelled(data: np.ndarray, at: np.ndarray):
    """Row, start, first eight bytes and bytes of each word of letters, and the number of clause breaks before it."""
    data = _LOWER[data]
    solid = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    head = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        head = (head << np.uint64(8)) | np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64)
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])[starts]
    return np.searchsorted(at, starts, "right") - 1, head, ends - starts, breaks


def beginning(head: np.ndarray, length: int) -> np.ndarray:
    """Code of the first ``length`` bytes: the length, then the bytes."""
    return (head >> np.uint64(8 * (8 - length))) | np.uint64(length << 56)


def _closed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, lengths and symbols of the fixed words; they differ in their first eight bytes."""
    found = sorted((int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "big"), len(w.encode()), s) for s, ws in CLOSED.items() for w in ws.split())
    heads, lengths, symbols = zip(*found)
    return np.array(heads, np.uint64), np.array(lengths), np.array(symbols)


def tagged(head: np.ndarray, length: np.ndarray, insults: np.ndarray) -> np.ndarray:
    """Symbol of each word; ``insults`` are sorted codes."""
    heads, lengths, symbols = _closed()
    at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
    out = np.where((heads[at] == head) & (lengths[at] == length), symbols[at], OTHER)
    if len(insults):
        for k in PREFIXES:
            code = beginning(head, k)
            at = np.minimum(np.searchsorted(insults, code), len(insults) - 1)
            out[(length >= k) & (insults[at] == code)] = INSULT
    return out


def clause_counts(data: np.ndarray, at: np.ndarray, insults: np.ndarray) -> np.ndarray:
    """[row, kind] clauses of each kind (a clause counts once a kind), and in the last column all clauses."""
    out = np.zeros((len(at) - 1, len(KINDS) + 1), np.int64)
    if not len(data):
        return out
    row, head, length, breaks = spelled(data, at)
    if not len(row):
        return out
    clause = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])]))
    symbol = tagged(head, length, insults)
    np.add.at(out[:, -1], row[np.concatenate([[True], clause[1:] != clause[:-1]])], 1)
    # Only clauses with an insult or threat can say something; the others are passed over.
    loud = np.zeros(clause[-1] + 1, bool)
    loud[clause[(symbol == INSULT) | (symbol == THREAT)]] = True
    goes, says = GRAMMAR[0].tolist(), GRAMMAR[1].tolist()
    seen: set[tuple[int, int, int]] = set()
    state, last = 0, -1
    pick = np.flatnonzero(loud[clause])
    for r, c, s in zip(row[pick].tolist(), clause[pick].tolist(), symbol[pick].tolist()):
        if c != last:
            state, last = goes[state][BREAK], c
        kind, state = says[state][s], goes[state][s]
        if kind:
            seen.add((r, c, kind))
    for r, _, kind in seen:
        out[r, kind - 1] += 1
    return out


def features(counts: np.ndarray) -> np.ndarray:
    kinds, clauses = counts[:, :-1], np.maximum(1, counts[:, -1:])
    return np.hstack([np.log1p(kinds), kinds[:, :4].sum(axis=1, keepdims=True) / clauses])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic fit (Newton steps), the constant first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (code, toxic documents, clean documents) of each slice."""
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        data, at = C.text_buffer(batch.column(1))
        for i, j in C.slices(at):
            if at[j] == at[i]:
                continue
            row, head, length, _ = spelled(data[at[i] : at[j]], at[i : j + 1] - at[i])
            codes = [(row[length >= k], beginning(head[length >= k], k)) for k in PREFIXES]
            row, code = (np.concatenate(x) for x in zip(*codes))
            order = np.lexsort((row, code))
            row, code = row[order], code[order]
            fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])[: len(code)]
            code, bad = code[fresh], toxic[i:j][row[fresh]] == 1
            each, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
            hits = np.bincount(inverse, bad, len(each)).astype(np.int64)
            yield pa.record_batch([pa.array(each.view(np.int64)), pa.array(hits), pa.array(n - hits)], names=["code", "bad", "good"])


def _counts(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.text_buffer(batch.column(1))
            for i, j in C.slices(at):
                counts = clause_counts(data[at[i] : at[j]], at[i : j + 1] - at[i], held.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, counts.shape[1]), pa.int32()), pa.array(counts.ravel()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), flat], names=["toxic", "counts"])

    return run


def learn(docs: DataFrame, labels: DataFrame, usable: Column):
    """(sorted insult codes, weights) from labelled rows of ``docs`` for which ``usable`` holds."""
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(usable)
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = min(1.0, SAMPLE / max(1, sum(totals.values())))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = C.cut_lineage(docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text"))
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), sum(n for k, n in size.items() if k != 1)
    none = np.zeros(0, np.uint64)
    if not bad or not good:
        rate = totals.get(1, 0) / max(1, sum(totals.values()))
        return none, rate
    seen = texts.mapInArrow(_beginnings, "code long, bad long, good long").groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    best = seen.where((F.col("bad") >= SUPPORT) & (odds >= ODDS)).orderBy(F.desc(F.col("bad") * F.log(odds)), "code").limit(LEXICON)
    insults = np.sort(np.array([r.code for r in best.collect()], np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(insults)
    rows = texts.mapInArrow(_counts(held), "toxic int, counts array<long>").groupBy("toxic", "counts").count().collect()
    counts, y = np.array([r.counts for r in rows]), np.array([r.toxic == 1 for r in rows], float)
    times = np.array([r["count"] for r in rows])
    return insults, fitted(np.repeat(features(counts), times, axis=0), np.repeat(y, times))


def score(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """_row, doc_id, score (0 to 1) and the clause counts for each row of ``docs``.

    ``usable`` is a condition on ``doc_id``: labels are learned where it holds.
    """
    insults, weights = learn(docs, labels, usable)
    held = docs.sparkSession.sparkContext.broadcast(insults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.text_buffer(batch.column(2))
            for i, j in C.slices(at):
                counts = clause_counts(data[at[i] : at[j]], at[i : j + 1] - at[i], held.value)
                if isinstance(weights, float):
                    value = np.full(j - i, weights)
                else:
                    value = 1 / (1 + np.exp(-np.clip(weights[0] + features(counts) @ weights[1:], -30, 30)))
                kinds = [pa.array(counts[:, k]) for k in range(len(KINDS))]
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(value), *kinds], names=["_row", "doc_id", "score", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.with_row(docs, "doc_id", "text").mapInArrow(run, f"_row long, doc_id {kind}, score double, " + ", ".join(f"{n} long" for n in NAMES))


NAMES = tuple(k.replace(" ", "_") for k in KINDS)


def remove(docs: DataFrame, labels: DataFrame, usable: Column, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``least`` or more."""
    bad = score(docs, labels, usable).where(F.col("score") >= least).select("_row")
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), C.as_struct(docs.columns).alias("_doc"))
    left = numbered.join(bad.hint("shuffle_hash"), "_row", "left_anti")
    return left.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
