"""Toxicity by weak supervision.

1. Lexicon entries (words, and word beginnings of 4 to 8 bytes, which catch
   inflected families) are counted over all labelled training documents, and
   the entries whose log odds are surely high are kept.
2. Voters: the entries are dealt to lexicon voters by rank, and pattern
   voters look at second-person insults, shouting and exclamations.
   One pass over the whole texts stores each document's votes and entries.
3. A generative label model explains the vote patterns of all documents by a
   hidden label: the rate at which each voter fires for either label (its
   accuracy) and the correlations between voters, as a dependency tree, are
   estimated by expectation maximisation on the pattern counts.  Training
   labels, where there are any, pin the hidden label.
4. A linear classifier on entries and patterns is fitted to the posterior
   labels of a bounded sample of rows, and scores every document.

Labels are read only for rows whose fold (crc32 of the id's text mod 3) is
not ``HELD_OUT_FOLD``.  Only the text enters a score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgprep.llm.common import broadcast_if_small, map_texts, written

FOLDS, HELD_OUT_FOLD = 3, 1
BEGINNINGS = (4, 5, 6, 7, 8)
LEXICON_VOTERS = 8
SAMPLE_ROWS = 30_000  # bound of the sample that the classifier is fitted on
POSTERIOR_WEIGHT = 0.3  # of a row whose label is the model's, against one with a label of its own
THRESHOLD = 0.7
LABEL_BYTES = 64 << 20
# Fixed seed words of one voter: general English insults.
SEED_INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
                "clown", "jerk", "freak", "ugly", "hate", "fool", "filth", "garbage", "vermin", "imbecile")
PATTERNS = (rb"\byou(?:'re| are| r)? (?:an? |such |so |all )*(?:" + "|".join(SEED_INSULTS).encode() + rb")",
            rb"\b[A-Z]{3,}\b(?:\s+[A-Z]{3,}\b){2,}", rb"!{2,}|\?{2,}|!\?")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def entry_reader():
    """``entries(text)`` -> the set of words, and for each of BEGINNINGS the set of longer words' first bytes."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    fold = bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))

    def entries(text):
        words = set(text.translate(fold).split())
        out, longer = [words], words
        for n in BEGINNINGS:
            longer = [w for w in longer if len(w) > n]
            out.append({w[:n] for w in longer})
        return out

    return entries


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training folds; of several labels of a document the toxic one counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def induced_lexicon(labelled: DataFrame) -> list[tuple[int, bytes]]:
    """All (kind, entry) pairs that are surely associated with the label, best first.

    ``labelled`` has text and toxic.  Counts are documents; they cover every labelled row.
    A beginning stays beside its word also where both are in the same
    labelled documents: elsewhere it finds forms that no label shows.
    """
    def run(batches):
        read, counts = entry_reader(), {}

        def frame():
            out = pd.DataFrame([(k, w, c[1], c[0]) for (k, w), c in counts.items()],
                               columns=["kind", "entry", "toxic", "clean"])
            counts.clear()
            return out

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for kind, found in enumerate(read((text or "").encode("utf-8", "surrogatepass"))):
                    for w in found:
                        counts.setdefault((kind, w), [0, 0])[toxic] += 1
                if len(counts) > 1_000_000:
                    yield frame()
        yield frame()

    per_label = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = per_label.get(1, 0), per_label.get(0, 0)
    if not n1 or not n0:
        return []
    rows = labelled.select("text", "toxic").mapInPandas(run, "kind int, entry binary, toxic long, clean long")
    rows = rows.groupBy("kind", "entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1 - F.col("t") + 0.5)) - F.log(
        (F.col("c") + 0.5) / (n0 + 1 - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = rows.where("t >= 3").withColumn("sure", odds - 2 * error).where(F.col("sure") > 0.7)
    best = rows.orderBy(F.col("sure").desc(), "kind", "entry").collect()
    return [(r["kind"], bytes(r["entry"])) for r in best]


def cast_votes(docs: DataFrame, lexicon: list[tuple[int, bytes]], keep: list[str]) -> DataFrame:
    """``keep`` columns with votes (a bit mask of voters) and hits (features: entries, then patterns)."""
    voters = LEXICON_VOTERS

    def make():
        import re

        read = entry_reader()
        number = [{w: i for i, (k, w) in enumerate(lexicon) if k == kind} for kind in range(1 + len(BEGINNINGS))]
        lookup = [set(n) for n in number]
        seeds = {w.encode() for w in SEED_INSULTS}
        # only the first pattern ignores case: the second looks for capitals
        patterns = [re.compile(p, re.I if i == 0 else 0) for i, p in enumerate(PATTERNS)]

        def values(texts):
            votes, hits = [], []
            for text in texts:
                raw = (text or "").encode("utf-8", "surrogatepass")
                found = read(raw)
                hit = sorted(number[k][w] for k in range(1 + len(BEGINNINGS)) for w in found[k] & lookup[k])
                vote = 0
                for i in hit:
                    vote |= 1 << (i % voters)
                if found[0] & seeds:
                    vote |= 1 << voters
                for j, p in enumerate(patterns):
                    if p.search(raw):
                        vote |= 1 << (voters + 1 + j)
                        hit.append(len(lexicon) + j)
                votes.append(vote)
                hits.append(hit)
            return votes, hits

        return values

    return map_texts(docs, keep, make, "votes int, hits array<int>")


def label_model(patterns, rounds: int = 40):
    """Posterior of label 1 for each vote mask, from (votes, toxic or None, count) rows of all documents.

    Naive firing rates would count correlated voters several times, so each
    label's votes follow a tree (Chow and Liu): a voter depends on the label
    and on its neighbour in the tree of largest mutual information.
    """
    import numpy as np

    m = LEXICON_VOTERS + 1 + len(PATTERNS)
    masks = np.array([p[0] for p in patterns], np.int64)
    v = (masks[:, None] >> np.arange(m)) & 1
    known = np.array([-1 if p[1] is None else p[1] for p in patterns])
    n = np.array([p[2] for p in patterns], float)
    fired = v[:, :LEXICON_VOTERS + 1].sum(1)
    q = np.where(known >= 0, known, np.select([fired >= 2, fired == 1], [0.9, 0.4], 0.02)).astype(float)
    both = np.stack([1 - v, v], axis=2).reshape(len(v), 2 * m).astype(float)  # indicator of each voter's value

    for _ in range(rounds):
        joint = []
        for y in (0, 1):
            w = n * (q if y else 1 - q)
            c = (both * w[:, None]).T @ both
            joint.append(((c.reshape(m, 2, m, 2).transpose(0, 2, 1, 3) + 0.25) / (w.sum() + 1), w.sum()))
        information = np.zeros((m, m))
        for table, weight in joint:
            single = table.sum(3)  # P(voter value), the same for every partner up to smoothing
            ratio = np.log(table / (single[:, :, :, None] * table.sum(2)[:, :, None, :]))
            information += weight / n.sum() * (table * ratio).sum((2, 3))
        parent, inside = [-1] * m, [0]
        while len(inside) < m:
            outside = [j for j in range(m) if j not in inside]
            i, j = max(((i, j) for i in inside for j in outside), key=lambda e: information[e])
            parent[j] = i
            inside.append(j)
        logs = []
        for table, weight in joint:
            total = np.full(len(v), np.log(weight / n.sum() + 1e-12))
            for j in range(m):
                i = parent[j]
                if i < 0:
                    total += np.log(table[j, (j + 1) % m].sum(1))[v[:, j]]
                else:
                    given = table[i, j] / table[i, j].sum(1, keepdims=True)
                    total += np.log(given[v[:, i], v[:, j]])
            logs.append(total)
        free = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        new = np.where(known >= 0, known, free)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return dict(zip(masks.tolist(), free.tolist()))


def fit_linear(rows, n_features: int, ridge: float = 0.5, rounds: int = 25):
    """Logistic regression by Newton's method on rows of (hits, target, weight).

    Only the hits are stored, and a step is solved by conjugate gradients, so
    memory grows with the hits and not with rows times features.
    """
    import numpy as np

    lengths = [len(r[0]) for r in rows]
    at = np.repeat(np.arange(len(rows)), lengths)
    cols = np.fromiter((c for r in rows for c in r[0]), np.int64, sum(lengths))
    t, weight = (np.array([r[k] for r in rows], float) for k in (1, 2))

    def forward(w):
        return np.bincount(at, weights=w[cols], minlength=len(rows)) + w[-1]

    def back(v):
        out = np.bincount(cols, weights=v[at], minlength=n_features + 1)
        out[-1] += v.sum()
        return out

    w = np.zeros(n_features + 1)
    penalty = np.full(n_features + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        gradient = back(weight * (p - t)) + penalty * w
        curvature = weight * np.maximum(p * (1 - p), 1e-6)
        scale = 1 / (back(curvature) + penalty)
        step, rest = np.zeros_like(w), gradient.copy()
        z = scale * rest
        along, size = z, rest @ z
        least = 1e-12 * size
        for _ in range(500):
            if size <= least:
                break
            bent = back(curvature * forward(along)) + penalty * along
            move = size / (along @ bent)
            step += move * along
            rest -= move * bent
            z = scale * rest
            size, last = rest @ z, size
            along = z + size / last * along
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(lexicon, weights, votes): what scoring needs, and the stored votes (doc_id, votes, hits) of all rows."""
    known = written(training_labels(labels).withColumnRenamed("doc_id", "_id"), "labels")
    known = broadcast_if_small(known, LABEL_BYTES)
    narrow = docs.select("doc_id", "text")
    lexicon = induced_lexicon(narrow.join(known, F.col("doc_id") == F.col("_id")))
    voted = written(cast_votes(narrow, lexicon, ["doc_id"]), "votes")
    with_label = voted.join(known, F.col("doc_id") == F.col("_id"), "left")
    # at most 2 ** voters masks with three kinds of label
    patterns = with_label.groupBy("votes", "toxic").count().collect()
    if not patterns:
        return lexicon, [0.0] * (len(lexicon) + len(PATTERNS) + 1), voted
    posterior = label_model([(r["votes"], r["toxic"], r["count"]) for r in patterns])
    total = sum(r["count"] for r in patterns)
    share = F.pmod(F.xxhash64("doc_id", "hits"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / total))
    sample = with_label.where(share).select("votes", "hits", "toxic").limit(2 * sample_rows).collect()
    rows = [(r["hits"], posterior[r["votes"]], POSTERIOR_WEIGHT) if r["toxic"] is None else
            (r["hits"], float(r["toxic"]), 1.0) for r in sample]
    return lexicon, [float(w) for w in fit_linear(rows, len(lexicon) + len(PATTERNS))], voted


def with_score(voted: DataFrame, weights: list[float]) -> DataFrame:
    """``voted`` with held_out, score and predicted in the place of votes and hits."""
    # one literal, however long the lexicon is
    table = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    logit = F.aggregate(F.transform("hits", lambda i: F.get(table, i)), F.lit(weights[-1]), lambda a, w: a + w)
    scored = voted.select("*", held_out(F.col("doc_id")).alias("held_out"),
                          (1 / (1 + F.exp(-logit))).alias("score")).drop("votes", "hits")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted added, one row per document row.

    Null and empty texts have no entries and are scored by the intercept.  A
    null id is a training row without a label.  Without labels of both kinds
    only the seed and pattern voters are left.  Names that clash with the
    added columns are replaced.  Texts are read a second time for the result
    rather than stored with the votes.
    """
    carried = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "votes", "hits")]
    lexicon, weights, _ = fit(docs, labels)
    return with_score(cast_votes(docs.select(*carried), lexicon, carried), weights)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    _, weights, voted = fit(docs, labels)
    return with_score(voted, weights).select("doc_id", "held_out", "score", "predicted")
