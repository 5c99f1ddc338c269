"""Quality without labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed linear scorer learns.

1. Each labeller reads one statistic of a whole text and votes good, bad or not at all.
2. All documents' vote patterns are counted. Over the counts (at most 3 ** labellers of them, however many documents), EM
   estimates how often each labeller votes what on good and on bad documents, the share of good ones, and so each pattern's
   posterior.
3. A logistic model over hashed features learns the posteriors of a bounded sample, and scores every document.

A document on which no labeller votes has nothing held against it: it stays whatever its score, and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import U64, Run, column_or_null, mix, word_runs
from tamis.llm.minhash import shingle_sets

#: name, good at most, bad at least, words that a text must have for a vote. Between the two there is no vote.
LABELLERS = (
    ("odd_endings", 0.05, 0.30, 5),
    ("no_letters", 0.12, 0.25, 5),
    ("upper_case", 0.30, 0.60, 8),
    ("stutter", 0.05, 0.20, 8),
    ("few_pairs", 0.35, 0.60, 30),
    ("copied_lines", 0.40, 0.75, 30),
    ("shouting", 0.10, 0.40, 8),
    ("no_sentences", 0.97, 0.995, 60),
    ("punctuation", 0.04, 0.065, 30),
    ("one_word", 0.12, 0.25, 20),
)
NAMES = [x[0] for x in LABELLERS]
#: The pattern of a document on which no labeller votes.
NO_VOTE = 0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PUNCTUATION = ~_LETTER & (np.arange(256) > 0x20)
_PLAIN_END = _LETTER.copy()
_PLAIN_END[list(b".,;:?!)]}\"'")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:")] = True
_NEWLINE = np.arange(256) == 0x0A
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B], _LOWER[0x61:0x7B] = True, True


def statistics(run: Run) -> np.ndarray:
    """A row for each text of the run: its words, then the statistic of each labeller, from 0 (good) to 1 (bad)."""
    n = np.diff(run.first).astype(float)
    some = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return (total[run.first[1:]] - total[run.first[:-1]]) / some

    def bytes_in(table: np.ndarray, where: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[run.data])))
        return total[where]

    last = run.data[run.ends - 1] if len(run.ends) else np.empty(0, np.uint8)
    before = run.data[np.maximum(run.ends - 2, 0)] if len(run.ends) else last
    bare = bytes_in(_LETTER, run.ends) == bytes_in(_LETTER, run.starts)
    upper, lower = (np.diff(bytes_in(t, run.offsets)) for t in (_UPPER, _LOWER))
    again = np.zeros(len(run.hashes), bool)
    again[1:] = run.hashes[1:] == run.hashes[:-1]
    again[run.first[:-1][n > 0]] = False
    _, bounds = shingle_sets(run, 2)
    copied = np.zeros(len(n))
    for k in np.flatnonzero(np.diff(bytes_in(_NEWLINE, run.offsets))):
        lines = [x for x in run.data[run.offsets[k] : run.offsets[k + 1]].tobytes().split(b"\n") if x]
        if len(lines) > 1:
            copied[k] = 1 - sum(map(len, set(lines))) / sum(map(len, lines))
    most = np.zeros(len(n))
    if len(run.hashes):
        text = run.word_text()
        order = np.lexsort((run.hashes, text))
        word, text = run.hashes[order], text[order]
        at = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1]))))
        times, text = np.diff(np.append(at, len(word))), text[at]
        firsts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        most[text[firsts]] = np.maximum.reduceat(times, firsts) / n[text[firsts]]
    marks = np.diff(bytes_in(_PUNCTUATION, run.offsets)) / np.maximum(np.diff(bytes_in(_PUNCTUATION | _LETTER, run.offsets)), 1)
    few = 1 - np.diff(bounds) / np.maximum(n - 1, 1)
    return np.stack([n, share(~_PLAIN_END[last] & ~bare), share(bare), upper / np.maximum(upper + lower, 1), share(again), np.clip(few, 0, 1), copied, share((last == 0x21) & (before == 0x21)), 1 - share(_STOP[last]), marks, most], 1)


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 none."""
    out = np.full((len(stats), len(LABELLERS)), -1, np.int64)
    for k, (_, good, bad, least) in enumerate(LABELLERS):
        enough = stats[:, 0] >= least
        out[enough & (stats[:, k + 1] <= good), k] = 1
        out[enough & (stats[:, k + 1] >= bad), k] = 0
    return out


def patterns(vote: np.ndarray) -> np.ndarray:
    """Votes of all labellers as one number."""
    return (vote + 1) @ (3 ** np.arange(vote.shape[1]))


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior that a pattern is good; how often each labeller votes (none, bad, good) on bad and on good documents; the
    share of good ones. Starts from the share of good votes, a little in favour of good."""
    vote = (pattern[:, None] // 3 ** np.arange(labellers)) % 3
    one = np.eye(3)[vote]  # pattern, labeller, vote
    bad, good = (vote == 1).sum(1), (vote == 2).sum(1)
    post = np.where(bad == 0, 0.95, np.where(bad >= 2, 0.05, (good + 1) / (good + 10)))
    rates, prior = np.zeros((2, labellers, 3)), 0.5
    for _ in range(rounds):
        for y, weight in enumerate(((1 - post) * count, post * count)):
            made = np.einsum("p,plv->lv", weight, one) + np.array([[0.5, 0.4, 0.1], [0.5, 0.1, 0.4]])[y]
            rates[y] = made / made.sum(1, keepdims=True)
        prior = float((post @ count + 1) / (count.sum() + 2))
        # a labeller that doesn't vote says nothing
        say = np.where(np.arange(3) == 0, 0.0, np.log(rates))
        lift = np.einsum("plv,lv->p", one, say[1] - say[0]) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(lift, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return dict(zip(pattern.tolist(), post.tolist(), strict=True)), rates, prior


def features(run: Run, stats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts of the run: shares of words and of words' last two bytes, which no labeller sees, one
    after the other, with the places where texts begin and end; and a row of steps of its statistics for each text."""
    mask = U64((1 << bits) - 1)
    last = run.data[run.ends - 1].astype(np.int64) if len(run.ends) else np.empty(0, np.int64)
    before = run.data[np.maximum(run.ends - 2, 0)].astype(np.int64) if len(run.ends) else last
    ending = last + 256 * np.where(run.ends - run.starts > 1, before, 0)
    ending = mix(ending.astype(U64) + U64(1 << 20)) & mask
    # words and endings of a text in one sort: a text's features lie together
    text = run.word_text().astype(U64) << U64(32)
    keys, count = np.unique(np.concatenate((text | run.hashes & mask, text | ending)), return_counts=True)
    ids = (keys & U64((1 << 32) - 1)).astype(np.int64)
    cut = np.searchsorted(keys, np.arange(len(stats) + 1).astype(U64) << U64(32))
    share = np.sqrt(count / np.maximum(1, np.repeat(2 * np.diff(run.first), np.diff(cut))))
    edges = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9])
    step = np.searchsorted(edges, stats[:, 1:], "right")
    step[stats[:, :1] < np.array([x[3] for x in LABELLERS])] = 15
    own = (mix((np.arange(step.shape[1]) * 16 + step).astype(U64) + U64(1 << 30)) & mask).astype(np.int64)
    return ids, share.astype(np.float32), cut, own


def by_text(made: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, share, cut, own = made
    ones = np.ones(own.shape[1], np.float32)
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        yield np.concatenate((ids[a:b], own[k])), np.concatenate((share[a:b], ones))


def weighed(made: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    """The sum of each text's features, times their weights."""
    ids, share, cut, own = made
    each = np.append(w[ids].astype(float) * share, 0.0)  # a text without words begins where the features may end
    some = np.diff(cut) > 0
    out = w[own].astype(float).sum(1)
    if some.any():
        out[some] += np.add.reduceat(each, cut[:-1][some])
    return out


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model over sparse rows with soft targets, by Adam over all rows at a time."""
    ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    weight = np.ones(len(rows)) if weight is None else weight
    weight = weight / weight.sum()
    seen = np.zeros(size, bool)
    seen[ids] = True
    used = np.flatnonzero(seen)
    ids = (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    w, b = np.zeros(len(used) + 1), 0.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        z = np.bincount(row, values * w[ids], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.append(np.bincount(ids, values * error[row], len(used)) + ridge * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(size)
    out[used] = w[:-1]
    b = float(w[-1])
    return out, b


def learn(docs: DataFrame, bits: int = 18, sample: int = 8_000, sample_bytes: int = 32 << 20) -> tuple[Callable, dict]:
    """Scorer (run -> votes' patterns, scores) learned from docs (doc_id, text), and what EM estimated.

    Patterns of all documents are counted. The scorer learns from at most `sample` different texts and `sample_bytes` bytes
    of text: those with the least hashes, each once however often it comes. Without documents it finds everything good.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([patterns(votes(statistics(r))) for r in word_runs(batch.column(0))] or [np.empty(0, np.int64)])
            pattern, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in word_runs(batch.column(0)):
                stats = statistics(r)
                made = list(by_text(features(r, stats, bits)))
                yield pa.RecordBatch.from_arrays([pa.array(patterns(votes(stats))), pa.array([x.astype(np.int32).tobytes() for x, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], ["pattern", "ids", "shares"])

    text = column_or_null(docs, "text", "string").alias("text")
    rows = docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()  # at most 3 ** labellers
    if not rows:
        return (lambda r: (np.zeros(r.hi - r.lo, np.int64), np.ones(r.hi - r.lo))), {}
    rows.sort()
    pattern, n = (np.array(x) for x in zip(*rows, strict=True))
    post, rates, prior = expectation_maximisation(pattern, n.astype(float))
    hashed = docs.select(text).where("text is not null").withColumn("key", F.xxhash64("text"))
    part = min(1.0, 4 * sample / n.sum())  # hashes are sorted of so many only
    few = hashed.where(F.pmod("key", F.lit(1_000_000)) <= int(part * 1_000_000)).select("key", F.octet_length("text").alias("size"))
    least = few.distinct().orderBy("key", "size").limit(sample).collect()
    size = np.cumsum([r["size"] for r in least])
    own = max(1, int(np.searchsorted(size, sample_bytes, "right")))
    chosen = hashed.where(F.pmod("key", F.lit(1_000_000)) <= int(part * 1_000_000)).where(F.col("key") <= (least[:own][-1].key if least else 0))
    taken = sorted(tuple(x) for x in chosen.dropDuplicates(["key"]).select("text").mapInArrow(sampled, "pattern long, ids binary, shares binary").where(F.col("pattern") != NO_VOTE).collect())
    if not taken:
        return (lambda r: (patterns(votes(statistics(r))), np.array([post[p] for p in patterns(votes(statistics(r))).tolist()]))), {"prior": prior, "posterior": post}
    w, b = fit_logistic([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for _, i, s in taken], np.array([post[p] for p, _, _ in taken]), 1 << bits)
    w = w.astype(np.float32)

    def score(run: Run) -> tuple[np.ndarray, np.ndarray]:
        stats = statistics(run)
        z = weighed(features(run, stats, bits), w) + b
        return patterns(votes(stats)), 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    accuracy = {name: {"bad": rates[0, k].tolist(), "good": rates[1, k].tolist()} for k, name in enumerate(NAMES)}
    return score, {"prior": prior, "accuracy": accuracy, "posterior": post}


def score_documents(docs: DataFrame, threshold: float = 0.5, bits: int = 18, sample: int = 8_000) -> DataFrame:
    """All columns of docs (doc_id, text and others), with quality_score (0 to 1), weak_label (the posterior of its votes)
    and keep (score at least `threshold`, or no labeller votes).

    Null and empty texts get no votes, so they stay; labels aren't read; repeated rows score alike; columns with these names
    are replaced; an empty table gives no rows.
    """
    made = ("quality_score", "weak_label", "keep")
    docs = docs.drop(*made)
    score, found = learn(docs.select("doc_id", "text"), bits, sample)
    post = found.get("posterior", {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score(r) for r in word_runs(batch.column(batch.schema.get_field_index("text")))]
            pattern = np.concatenate([x for x, _ in got] or [np.empty(0, np.int64)])
            s = np.concatenate([x for _, x in got] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array([post.get(p, 1.0) for p in pattern.tolist()]), pa.array((s >= threshold) | (pattern == NO_VOTE))], [*batch.schema.names, *made])

    text = docs.withColumn("text", column_or_null(docs, "text", "string"))
    return text.mapInArrow(run, f"{_schema(text)}, quality_score double, weak_label double, keep boolean")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
