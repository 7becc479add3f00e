"""Language-model scoring by logistic context mixing.

A text is coded bit by bit in its order: the bytes of each word and then a
space; the end of a text is one line feed.  Before each bit, several
predictors look up how often a 0 or a 1 followed in their context: hashed
tables for the last 1 to 4 bytes of the text, across words, and
the exact node of the whole word so far.  Their logits are mixed by weights
that a gate chooses (bit position, and how much the two most specific
contexts have seen), the weights learn online, and a last adaptive map
refines the mixed probability by what came true at that probability.  The
bits make a proper probability for any text, so ``score`` is comparable
with a unigram model that knows its vocabulary only.

The last 4 bytes reach back beyond a word's start in its first 3 bytes only.  So a
token is coded in two parts: its junction, which is its first 3 bytes after the
last bytes of the text before it, and the rest of the word, which has the same
contexts wherever it stands.  Each is coded once for many tokens; no context is cut.
What a document is like is a context of all its words: training documents
are classed by their most frequent word, each class tilts the rest of a word,
given its first 3 bytes, by how often the words belong to it, and a document's
probability is the mixture over classes (the weight of a class follows the
words as they come).  The steps:

1. Documents are cut into blocks; a block stores its distinct words with
   their training counts, its documents as block words in their order, and how often
   training documents hold each junction.
2. Training counts are summed per distinct word and per junction over all training documents.
3. Words are dealt by their first bytes, junctions by what comes before.  Each task adds up the context
   tables for its words or junctions; tables are summed by Spark into a model of fixed
   size (``SLOTS``), which is what is broadcast.
4. Each task trains weights and the adaptive map online on all its training
   words or junctions; a token that is predicted is first taken out of its own
   counts, as if it had not been seen.  Weights are averaged by the
   tokens they learned from, the maps are summed.
5. The rest of each distinct word is scored and joined to the blocks; a block's task
   scores its junctions and sums both along each document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgprep.llm.common import written

FOLDS, HELD_OUT_FOLD = 5, 1
BLOCK_TOKENS = 2_500_000
CLASSES = 8  # the most common classes, and one for all others
PARTITION_WORDS = 250_000
SLOTS = (1 << 17, 1 << 19, 1 << 20, 1 << 20)  # of the tables for the last 1, 2, 3 and 4 bytes
CHUNK = 1 << 13
BATCH = 1 << 15
TRAIN_BATCH = 1 << 13
START_BYTES = 3  # of a word, with contexts that begin before it; words with the same are in one partition
TEXTS = 256  # documents decoded at a time
MET = 2_000_000  # junctions that a task counts before it stores them
KEYS = 250_000  # tokens whose junctions are worked out at a time
END = b"\n"
CLASS_COLUMNS = ", ".join(f"c{k} long" for k in range(CLASSES))
APM_CELLS = 33
INPUTS = len(SLOTS) + 2  # logits of the tables and of the word so far, and a constant
# The word so far: byte 0, 1 or 2, or else how long it has had one continuation and how often it was seen.
DETERMINED, SEEN = 5, 6
WORD_STATES = 3 + DETERMINED * SEEN
GATES = 8 * WORD_STATES * 3  # bit position, word so far, how much the last table has seen


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def block_table(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Stored rows of three kinds: documents (class word; ids of their block words in the order of the text), blocks
    (words; class words; training counts by class and word) and junctions (keys and training counts).

    All come from the same attempt of a task, so block numbers and word ids agree.
    """
    schema = ("kind int, block long, doc_id string, held_out boolean, n_tokens long, n_bytes long, class binary, "
              "a binary, b binary, c binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4]

        at, (pack, _), (numbers, _) = TaskContext.get().partitionId() << 20, packed_counts(), packed_numbers()
        vocabulary, spelled, rows, trained, tokens = {}, [], [], {}, 0
        none = np.zeros(0, np.int64)
        met = none, none  # junctions and their counts, of all blocks of the task while they are few

        def flush():
            nonlocal at, vocabulary, spelled, rows, trained, tokens, met
            places, times = [none], [none]
            for k, parts in enumerate(trained.values()):
                counts = np.bincount(np.concatenate(parts))
                places.append(np.nonzero(counts)[0] + k * len(spelled))
                times.append(counts[counts > 0])
            sums = pack(np.concatenate(places), np.concatenate(times))
            rows.append((1, at, None, None, len(vocabulary), 0, b" ".join(trained), b" ".join(spelled), *sums))
            # a few texts at a time: the keys of all tokens of a block at once would be the most that a task holds
            codes, end = word_codes(spelled), vocabulary[END]
            for texts in text_groups([ids for parts in trained.values() for ids in parts], KEYS):
                found = junction_keys(texts, *codes, end)
                found.sort()
                met = summed(met, distinct(found))
            if len(met[0]) > MET:
                add_junctions()
            out = batch()
            at, vocabulary, spelled, rows, trained, tokens = at + 1, {}, [], [], {}, 0
            return out

        def add_junctions():
            nonlocal met
            rows.append((2, at, None, None, len(met[0]), 0, None, numbers(np.diff(met[0], prepend=0)), numbers(met[1]), None))
            met = none, none

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        # a few texts at a time leave Arrow's buffers
        parts = (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256))
        for part in parts:
            for doc, out_of_training, text in zip(*[part.column(c).to_pylist() for c in range(3)]):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                n_bytes = sum(map(len, words)) + len(words) + len(END)  # as coded: a byte after each word, and the end
                words.append(END)
                number, ids = vocabulary.get, []
                for w in words:
                    i = number(w)
                    if i is None:
                        i = vocabulary[w] = len(spelled)
                        spelled.append(w)
                    ids.append(i)
                ids = np.array(ids, np.int64)
                held, times = np.unique(ids, return_counts=True)
                top = min(spelled[i] for i in held[times == times.max()].tolist())
                if not out_of_training:
                    trained.setdefault(top, []).append(ids.astype(np.int32))
                rows.append((0, at, doc, out_of_training, len(words), n_bytes, top, numbers(ids), None, None))
                tokens += len(words)
                if tokens >= block_tokens:
                    yield flush()
        if rows:
            yield flush()
        if len(met[0]):
            add_junctions()
            yield batch()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = rows.mapInArrow(run, schema)
    return written(rows, "blocks", ["kind"])


def text_groups(texts, tokens: int):
    """The arrays ``texts`` joined, in order, to arrays of ``tokens`` numbers or just over; no text is cut."""
    import numpy as np

    group, n = [], 0
    for text in texts:
        group.append(text)
        n += len(text)
        if n >= tokens:
            yield np.concatenate(group)
            group, n = [], 0
    if group:
        yield np.concatenate(group)


def distinct(keys):
    """(distinct keys, how often each is there) of sorted ``keys``."""
    import numpy as np

    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def summed(one, other):
    """(keys, counts), by key, of two such pairs with distinct keys in order: the counts of a key in both are added."""
    import numpy as np

    keys, counts = other
    if not len(one[0]) or not len(keys):
        return other if len(keys) else one
    at = np.searchsorted(one[0], keys)
    there = one[0][np.minimum(at, len(one[0]) - 1)] == keys
    one[1][at[there]] += counts[there]
    new = ~there
    return np.insert(one[0], at[new], keys[new]), np.insert(one[1], at[new], counts[new])


def packed_counts():
    """``pack(ids, times)`` and ``unpack(a, b)``: sorted ids as two-byte steps with one-byte counts.

    A step or count that is too large is spread over several entries (a
    step without a count, a count without a step), so nothing is cut off.
    """
    import numpy as np

    def pack(ids, times):
        steps = np.diff(ids, prepend=0)
        far, often = steps // 65535, (times - 1) // 255
        if far.any() or often.any():
            size = 1 + far + often
            at = np.cumsum(size) - size
            a, b = np.zeros(size.sum(), np.int64), np.zeros(size.sum(), np.int64)
            inside = np.arange(size.sum()) - np.repeat(at, size)
            a[inside < np.repeat(far, size)] = 65535
            a[at + far] = steps - 65535 * far
            b[inside > np.repeat(far, size)] = 255
            b[at + far] = times - 255 * often
            steps, times = a, b
        return steps.astype("<u2").tobytes(), times.astype("u1").tobytes()

    def unpack(a, b):
        return np.cumsum(np.frombuffer(a, "<u2").astype(np.int64)), np.frombuffer(b, "u1").astype(np.int64)

    return pack, unpack


def packed_numbers():
    """``pack(values)`` and ``unpack(data)``: numbers from 0 on in 7 bits a byte, low bits first, a high bit where more follow."""
    import numpy as np

    def pack(values):
        size, top, k = np.ones(len(values), np.int64), int(values.max(initial=0)), 7
        while top >> k:
            size += values >> k > 0
            k += 7
        at = np.cumsum(size) - size
        out = np.empty(size.sum(), np.uint8)
        for k in range(size.max(initial=0)):
            some = size > k
            out[at[some] + k] = (values[some] >> 7 * k) & 127 | ((size[some] > k + 1) << 7)
        return out.tobytes()

    def unpack(data):
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64)
        first = np.append(True, b[:-1] < 128)
        at = np.nonzero(first)[0]
        shift = 7 * (np.arange(len(b)) - at[np.cumsum(first) - 1])
        return np.add.reduceat((b & 127).astype(np.int64) << shift, at)

    return pack, unpack


def word_codes(words):
    """(start, tail, one) of each word: its first ``START_BYTES`` bytes as coded (0 after a space or the end), its
    last three bytes as they are before the space, and whether it has one byte only, so that a byte of the word before is missing."""
    import numpy as np

    n = np.fromiter(map(len, words), np.int64, len(words))
    buffer = np.frombuffer(b"   " + b" ".join(words) + b"   ", np.uint8)
    at = np.cumsum(n + 1) - n + 2

    def byte(places):
        return buffer[places].astype(np.int64)

    end = byte(at) == END[0]
    start = np.where(end, END[0] << 16, byte(at) << 16 | byte(at + 1) << 8 | np.where(n > 1, byte(at + 2), 0))
    last, one = at + n - 1, (n == 1) & ~end
    tail = np.where(one, 0, byte(last - 2)) << 16 | byte(last - 1) << 8 | byte(last)
    return start, np.where(end, 0x202020, tail), one


def junction_keys(ids, start, tail, one, end):
    """The junction of each token of texts that follow each other, each with its ``end``: the three bytes
    before the space, and the word's start.  What is before a text is spaces."""
    import numpy as np

    before = np.append(end, ids)[:-1]
    far = np.append(end, before)[:-1]
    return (tail[before] | np.where(one[before], (tail[far] & 255) << 16, 0)) << 24 | start[ids]


def common_classes(blocks: DataFrame) -> tuple[list[bytes], list[float]]:
    """The class words of most training documents, and the classes' shares (the last is for all others)."""
    rows = blocks.where("kind = 0 AND NOT held_out").groupBy("class").count()
    total = rows.agg(F.sum("count")).first()[0] or 0
    top = rows.orderBy(F.col("count").desc(), "class").limit(CLASSES - 1).collect()
    counts = [r["count"] for r in top] + [0] * (CLASSES - 1 - len(top))
    counts.append(total - sum(counts))
    return [bytes(r["class"]) for r in top], [(n + 0.5) / (total + 0.5 * CLASSES) for n in counts]


def block_words(blocks: DataFrame, classes: list[bytes]) -> DataFrame:
    """(block, id, word, c0, c1, ...): the distinct words of each block and their training counts by class."""
    def run(batches):
        import numpy as np

        number, (_, unpack) = {w: k for k, w in enumerate(classes)}, packed_counts()
        for pdf in batches:
            for block, tops, a, b, c in zip(pdf["block"], pdf["class"], pdf["a"], pdf["b"], pdf["c"]):
                words = a.split(b" ")
                # no class word is empty, but a block without training documents has none
                of = np.array([number.get(w, CLASSES - 1) for w in tops.split(b" ")])
                places, times = unpack(b, c)
                counts = np.bincount(places % len(words) * CLASSES + of[places // len(words)], times, len(words) * CLASSES)
                counts = counts.reshape(-1, CLASSES).astype(np.int64)
                yield pd.DataFrame({"block": block, "id": np.arange(len(words)), "word": words}
                                   | {f"c{k}": counts[:, k] for k in range(CLASSES)})

    return blocks.where("kind = 1").select("block", "class", "a", "b", "c").mapInPandas(
        run, "block long, id long, word binary, " + CLASS_COLUMNS)


def block_junctions(blocks: DataFrame) -> DataFrame:
    """(key, c): junctions of training documents and how often a task met them, perhaps in several rows."""
    def run(batches):
        import numpy as np

        _, unpack = packed_numbers()
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                yield pd.DataFrame({"key": np.cumsum(unpack(a)), "c": unpack(b)})

    return blocks.where("kind = 2").select("a", "b").mapInPandas(run, "key long, c long")


def first_weights():
    """The mixer before it has learned: the most specific context that is there for the state."""
    import numpy as np

    weights = np.zeros((GATES, INPUTS))
    early = np.arange(GATES) // 3 % WORD_STATES < START_BYTES
    weights[early, len(SLOTS) - 1] = 1
    weights[~early, len(SLOTS)] = 1
    return weights


def model_code(slots=SLOTS, batch: int = BATCH):
    """The functions that run in tasks: (table sums, training, scoring) of words or, if an array is given, of junctions.

    Of words, the bytes from ``first`` on are coded.
    """
    import numpy as np

    orders = len(slots)
    u = np.uint64
    n_inputs, n_gates = INPUTS, GATES

    class Words:
        """Sorted coded words as one buffer; yields the bit decisions in vectors.

        A decision is shared by all words that agree up to it.  Bytes at
        which a word is alone do not depend on other words, so all of these
        are laid out in one vector whatever their position.
        """

        def __init__(self, words, counts, first):
            self.first = first
            coded = [w if w == END else w + b" " for w in words]
            order = sorted(range(len(coded)), key=coded.__getitem__)
            self.order = np.array(order, np.int64)
            coded = [coded[i] for i in order]
            self.counts = np.asarray(counts, np.float64)[self.order]
            self.length = np.fromiter(map(len, coded), np.int64, len(coded))
            # four spaces in front of each word are what low orders see at its start
            self.buffer = np.frombuffer(b"".join(b"    " + w for w in coded), np.uint8)
            self.at = np.cumsum(self.length + 4) - self.length
            self.new = np.zeros(len(coded), bool)

        def contexts(self, place):
            """Hashes of the last 1 to 4 bytes before each place."""
            h, out = np.zeros(len(place), np.uint64), []
            for k in range(1, orders + 1):
                h = (h + self.buffer[place - k].astype(np.uint64) + u(1)) * u(0x9E3779B97F4A7C15)
                h ^= h >> u(29)
                out.append(h.copy())
            return out

        def decisions(self):
            """Yields (word rows, run starts or None, place of the next byte).

            With run starts, rows that agree so far are neighbours and share their
            decisions; without, each row stands alone, and a row can come with many places.
            """
            rows = np.arange(len(self.length))
            starts = self.new.copy()
            starts[:1] = True
            k, lone_rows, lone_from = 0, [], []
            while len(rows):
                # runs of one row leave the loop and are done as tails
                alone = starts & np.append(starts[1:], True)
                if k >= START_BYTES and alone.any():
                    lone_rows.append(rows[alone])
                    lone_from.append(np.full(int(alone.sum()), k))
                    rows, starts = rows[~alone], starts[~alone]
                    if not len(rows):
                        break
                place = self.at[rows] + k
                yield rows, starts, place
                byte = self.buffer[place]
                new = np.append(True, byte[1:] != byte[:-1]) if len(byte) else starts
                starts = starts | new
                more = self.length[rows] > k + 1
                # a word that ends here is not a neighbour of longer ones: its last byte ends it
                rows, starts = rows[more], starts[more]
                if len(rows):
                    starts[0] = True
                k += 1
            if lone_rows:
                rows, first = np.concatenate(lone_rows), np.concatenate(lone_from)
                left = self.length[rows] - first
                cuts = np.searchsorted(np.cumsum(left), np.arange(batch, left.sum() + batch, batch)) + 1
                edges = sorted({0, *np.minimum(cuts, len(rows)).tolist(), len(rows)})
                for a, b in zip(edges, edges[1:]):
                    r, n = np.repeat(rows[a:b], left[a:b]), left[a:b]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    place = self.at[r] + np.repeat(first[a:b], n) + step
                    for c in range(0, len(place), batch):
                        yield r[c:c + batch], None, place[c:c + batch]

        def nodes(self):
            """Yields per bit: (rows, node of each row, bit of each row, n0, n1, slot indexes, bit position, depth,
            bytes since the last branch).

            ``n0`` and ``n1`` are the training counts of the node's branches;
            there is a branch where both are above 0.
            """
            branch = np.zeros(len(self.length), np.int64)
            for rows, starts, place in self.decisions():
                byte, counts = self.buffer[place].astype(np.int64), self.counts[rows]
                run = starts
                depth = place - self.at[rows]
                passed = run is not None and depth[0] < self.first
                for j in range(8):
                    bit = (byte >> (7 - j)) & 1
                    partial = (1 << j) | (byte >> (8 - j))
                    if run is None:
                        head, node = np.arange(len(rows)), np.arange(len(rows))
                        n1 = counts * bit
                        n0 = counts - n1
                    else:
                        head = np.nonzero(run)[0]
                        node = np.cumsum(run) - 1
                        total = np.add.reduceat(counts, head)
                        n1 = np.add.reduceat(counts * bit, head)
                        n0 = total - n1
                    if not passed:
                        hashes = self.contexts(place[head])
                        salt = partial[head].astype(np.uint64) * u(0xD6E8FEB86659FD93)
                        index = []
                        for h, size in zip(hashes, slots):
                            x = (h ^ salt) * u(0xBF58476D1CE4E5B9)
                            index.append(((x >> u(32)) % u(size)).astype(np.int64))
                        yield rows, node, bit, n0, n1, index, j, depth[head], (depth - branch[rows])[head]
                    if run is not None:
                        split = ((n0 > 0) & (n1 > 0))[node]
                        branch[rows[split]] = depth[split]
                        change = np.append(True, bit[1:] != bit[:-1])
                        run = run | change

    class Junctions(Words):
        """Byte ``k`` of starts, after what its contexts see, in the same form; ``keys`` are sorted and distinct."""

        def __init__(self, keys, counts, k):
            self.counts, self.first, self.length = counts, k, np.full(len(keys), k + 1)
            self.buffer = np.insert(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:], 3, ord(" "), axis=1).reshape(-1)
            self.at = np.arange(len(keys)) * 7 + 4
            self.new = np.diff(keys >> 8 * (START_BYTES - k), prepend=-1) != 0

        def decisions(self):
            if len(self.at):
                yield np.arange(len(self.at)), self.new, self.at + self.first

    def coding(words, counts, first):
        """Yields (coded, rows, which): the bits of the words ``rows`` are those of ``coded`` at ``which``."""
        if not isinstance(words, np.ndarray):
            coded = Words(words, counts, first)
            yield coded, coded.order, np.arange(len(coded.order))
            return
        length = np.where(words >> 16 & 255 == END[0], 1, np.where(words >> 8 & 255 == ord(" "), 2, START_BYTES))
        for k in range(START_BYTES):
            # byte k of a start sees 3 - k bytes before the space and the start so far
            rows, low = np.nonzero(length > k)[0], 8 * (START_BYTES - 1 - k)
            keys = (words[rows] & ((1 << 8 * (2 * START_BYTES - k)) - 1)) >> low << low
            keys, which = np.unique(keys, return_inverse=True)
            yield Junctions(keys, np.bincount(which, np.asarray(counts)[rows], len(keys)), k), rows, which

    def table_sums(words, counts, first=0):
        tables = [np.zeros((size, 2)) for size in slots]
        with np.errstate(over="ignore"):
            for coded, *_ in coding(words, counts, first):
                for _, _, _, n0, n1, index, *_ in coded.nodes():
                    for table, i in zip(tables, index):
                        np.add.at(table, (i, 0), n0)
                        np.add.at(table, (i, 1), n1)
        return tables

    def inputs(tables, index, n0, n1, j, depth, since, less0, less1):
        """Logits of the predictors and the gate; ``less`` tokens are taken out of all counts."""
        x = np.ones((n_inputs, len(n0)))
        seen = None
        for k, (table, i) in enumerate(zip(tables, index)):
            a, b = table[i, 0] - less0, table[i, 1] - less1
            x[k] = np.log((np.maximum(b, 0) + 0.4) / (np.maximum(a, 0) + 0.4))
            seen = a + b
        a, b = n0 - less0, n1 - less1
        early = depth < START_BYTES  # there the last tables hold the word so far, over all parts
        x[orders] = np.where(early, 0, np.log((b + 0.4) / (a + 0.4)))
        n = a + b
        seen_so_far = (n > 0).astype(np.int64) + (n > 1) + (n > 2) + (n > 8) + (n > 40)
        state = START_BYTES + np.minimum(since, DETERMINED - 1) * SEEN + seen_so_far
        state = np.where(early, depth, state)
        gate = (j * WORD_STATES + state) * 3 + (seen > 2).astype(np.int64) + (seen > 40)
        return x, gate

    def mix(x, weights, gate):
        logit = np.clip((x * weights[gate].T).sum(0), -20, 20)
        return logit, 1 / (1 + np.exp(-logit))

    def cell(logit):
        return np.clip(np.rint(logit * 2) + APM_CELLS // 2, 0, APM_CELLS - 1).astype(np.int64)

    def refined(p, logit, gate, apm):
        """The mixed probability, averaged with what came true in its cell."""
        hit = apm[gate, cell(logit)]
        n = hit.sum(1)
        came = (hit[:, 1] + 8 * p) / (n + 8)
        return np.clip(0.5 * p + 0.5 * came, 1e-7, 1 - 1e-7)

    def train(words, counts, tables, first=0, ridge: float = 4.0):
        """Weights, tokens learned from by gate, and adaptive-map counts after one online pass.

        Steps are online Newton steps: each batch moves a gate's weights along
        its gradient, scaled by the curvature that the gate has seen so far.
        """
        weights = first_weights()
        curvature = np.tile(np.eye(n_inputs) * ridge, (n_gates, 1, 1))
        mass, apm = np.zeros(n_gates), np.zeros((n_gates, APM_CELLS, 2))
        with np.errstate(over="ignore"):
            nodes = (node for coded, *_ in coding(words, counts, first) for node in coded.nodes())
            for _, _, _, n0, n1, index, j, depth, since in nodes:
                # a node's tokens with a 0 and those with a 1, in random order
                cases = np.concatenate([np.nonzero(n0 > 0)[0], np.nonzero(n1 > 0)[0] + len(n0)])
                cases = cases[np.argsort(index[0][cases % len(n0)] * 7919 % 8191, kind="stable")]
                for c in range(0, len(cases), TRAIN_BATCH):
                    at, bit = cases[c:c + TRAIN_BATCH] % len(n0), cases[c:c + TRAIN_BATCH] // len(n0)
                    w = np.where(bit, n1[at], n0[at])
                    x, gate = inputs(tables, [i[at] for i in index], n0[at], n1[at], j, depth[at], since[at],
                                     1 - bit, bit)
                    logit, p = mix(x, weights, gate)
                    np.add.at(apm, (gate, cell(logit), bit), w)
                    mass += np.bincount(gate, w, n_gates)
                    used = np.unique(gate)
                    steep, error = w * np.maximum(p * (1 - p), 1e-4), w * (bit - p)
                    slope = np.empty((len(used), n_inputs))
                    for i in range(n_inputs):
                        slope[:, i] = np.bincount(gate, error * x[i], n_gates)[used]
                        for k in range(i, n_inputs):
                            more = np.bincount(gate, steep * x[i] * x[k], n_gates)
                            curvature[:, i, k] += more
                            if k > i:
                                curvature[:, k, i] += more
                    step = np.linalg.solve(curvature[used], slope[:, :, None])[:, :, 0]
                    weights[used] += np.clip(step, -0.5, 0.5)
        return weights, mass, apm

    def score(words, counts, tables, weights, apm, first=0):
        """log10 of each word's or junction's probability."""
        out = np.zeros(len(words))
        with np.errstate(over="ignore"):
            for coded, of, which in coding(words, counts, first):
                total = np.zeros(len(coded.length))
                for rows, node, bit, n0, n1, index, j, depth, since in coded.nodes():
                    x, gate = inputs(tables, index, n0, n1, j, depth, since, 0, 0)
                    logit, p = mix(x, weights, gate)
                    p = refined(p, logit, gate, apm)
                    np.add.at(total, rows, np.log10(np.where(bit == 1, p[node], 1 - p[node])))
                out[of] += total[which]
        return out

    return table_sums, train, score


def _partitioned(lexicon: DataFrame, n_words: int, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """(part, word, c): words with the same first bytes are in one part."""
    parts = max(1, -(-n_words // partition_words))
    start = F.substring("word", 1, START_BYTES)
    return lexicon.select(F.pmod(F.xxhash64(start), F.lit(parts)).cast("int").alias("part"), "*")


def _in_parts(lexicon: DataFrame, n_words: int, junctions: DataFrame, n_junctions: int, make, schema: str) -> DataFrame:
    """``make(words, counts)`` of each part of the words and of the junctions."""
    parts = max(1, -(-n_junctions // PARTITION_WORDS))
    before = F.pmod(F.xxhash64(F.shiftright("key", 24)), F.lit(parts))
    of_words = _partitioned(lexicon, n_words).groupBy("part").applyInPandas(
        lambda pdf: make(pdf["word"].tolist(), pdf["c"].to_numpy()), schema)
    return of_words.unionByName(junctions.withColumn("part", before).groupBy("part").applyInPandas(
        lambda pdf: make(pdf["key"].to_numpy(), pdf["c"].to_numpy()), schema))


def context_tables(lexicon: DataFrame, n_words: int, junctions: DataFrame, n_junctions: int):
    """Summed (zeros, ones) counts of every slot; len(SLOTS) arrays of fixed size."""
    import numpy as np

    def make(words, counts):
        table_sums, _, _ = model_code()
        out = []
        for k, table in enumerate(table_sums(words, counts, START_BYTES)):
            for c in range(0, len(table), CHUNK):
                part = table[c:c + CHUNK]
                if part.any():
                    out.append((k, c, part.astype("<f4").tobytes()))
        return pd.DataFrame(out, columns=["k", "at", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(b, "<f4").astype(float) for b in pdf["counts"])
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "at": pdf["at"].iloc[:1], "counts": [total.astype("<f4").tobytes()]})

    schema = "k int, at int, counts binary"
    rows = _in_parts(lexicon, n_words, junctions, n_junctions, make, schema)
    rows = written(rows.groupBy("k", "at").applyInPandas(add, schema), "tables")
    tables = [np.zeros((size, 2), np.float32) for size in SLOTS]
    for r in rows.collect():  # sum(SLOTS) counts at most
        part = np.frombuffer(r["counts"], "<f4").reshape(-1, 2)
        tables[r["k"]][r["at"]:r["at"] + len(part)] = part
    return tables


def mixing_weights(lexicon: DataFrame, n_words: int, junctions: DataFrame, n_junctions: int, tables):
    """(weights, adaptive map): averaged and summed over the parts, a few thousand numbers each."""
    import numpy as np

    shared = lexicon.sparkSession.sparkContext.broadcast(tables)

    def make(words, counts):
        _, train, _ = model_code()
        weights, mass, apm = train(words, counts, shared.value, START_BYTES)
        flat = np.concatenate([(weights * mass[:, None]).ravel(), mass, apm.ravel()])
        return pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    rows = _in_parts(lexicon, n_words, junctions, n_junctions, make, "i int, v double")
    rows = rows.groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(max((r["i"] for r in rows), default=-1) + 1)
    for r in rows:
        flat[r["i"]] = r["v"]
    ends = np.cumsum([GATES * INPUTS, GATES, GATES * APM_CELLS * 2])
    flat = flat if len(flat) else np.zeros(ends[-1])
    weights, mass, apm = np.split(flat, ends[:-1])
    weights = weights.reshape(GATES, INPUTS) / np.maximum(mass, 1e-9)[:, None]
    weights[mass == 0] = first_weights()[mass == 0]
    return weights, apm.reshape(GATES, APM_CELLS, 2)


def word_scores(lexicon: DataFrame, n_words: int, shared, shares) -> DataFrame:
    """(word, c, logp, belongs, ends) of every distinct word; ``logp`` is of what follows its start, ``belongs`` packs a byte for
    each class, in proportion to the probability that the word belongs to it, and ``ends`` packs ``word_codes``.
    ``shared`` is the broadcast model."""
    import numpy as np

    prior = np.array(shares)

    def run(pdf):
        _, _, score = model_code()
        words, counts = pdf["word"].tolist(), pdf["c"].to_numpy()
        by_class = pdf[[f"c{k}" for k in range(CLASSES)]].to_numpy()
        belongs = np.maximum(1, np.rint(255 * (by_class + prior) / (counts[:, None] + 1))).astype(np.uint8)
        start, tail, one = word_codes(words)
        return pd.DataFrame({"word": words, "c": counts,
                             "logp": score(words, counts, *shared.value, START_BYTES).astype(np.float32),
                             "belongs": np.ascontiguousarray(belongs).view("<i8").reshape(-1),
                             "ends": one.astype(np.int64) << 48 | tail << 24 | start})

    return _partitioned(lexicon, n_words).groupBy("part").applyInPandas(
        run, "word binary, c long, logp float, belongs long, ends long")


def _shares(belongs):
    """The class probabilities that ``belongs`` packs."""
    import numpy as np

    q = np.ascontiguousarray(belongs, "<i8").view(np.uint8).reshape(-1, CLASSES).astype(float)
    q /= q.sum(1, keepdims=True)
    return q


def class_masses(scores: DataFrame, shares):
    """(starts, masses, prior): for each start, in order, the probability of each class under the words that begin
    so, which makes the tilted probabilities of what follows it sum to 1.

    One row for each distinct start of ``START_BYTES`` bytes, however many words there are.
    """
    import numpy as np

    sums = [f"m{k}" for k in range(CLASSES + 1)]

    def run(batches):
        for pdf in batches:
            starts, at = np.unique(pdf["ends"].to_numpy() & 0xFFFFFF, return_inverse=True)
            p = 10 ** pdf["logp"].to_numpy().astype(float)
            q = np.column_stack([_shares(pdf["belongs"].to_numpy()) * p[:, None], p])
            yield pd.DataFrame({"start": starts} | {m: np.bincount(at, q[:, k], len(starts)) for k, m in enumerate(sums)})

    rows = scores.where("c > 0").select("logp", "belongs", "ends").mapInPandas(
        run, "start long, " + ", ".join(f"{m} double" for m in sums))
    rows = rows.groupBy("start").agg(*(F.sum(m).alias(m) for m in sums)).toPandas().sort_values("start")
    # all other words belong to the classes by their shares
    prior = np.array(shares) / np.sum(shares)
    total = rows[sums].to_numpy(float)
    return rows["start"].to_numpy(np.int64), total[:, :-1] + np.maximum(0, 1 - total[:, -1:]) * prior, prior


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A null or empty text is the end token alone.  Rows without an id are
    training rows.  If there are no training tokens all counts are zero.
    ``bits_per_byte`` divides the code length by the coded bytes (words, one
    byte after each, and the end).  Other columns are not read.
    """
    blocks = block_table(docs)
    classes, shares = common_classes(blocks)
    words = block_words(blocks, classes)
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES)]
    total = sum((F.col(f"c{k}") for k in range(1, CLASSES)), F.col("c0"))
    lexicon = written(words.groupBy("word").agg(*sums).withColumn("c", total), "lexicon")
    n_all, n_distinct, n_train = lexicon.agg(
        F.count("word"), F.sum((F.col("c") > 0).cast("long")), F.sum("c")).first()
    n_distinct, n_train = n_distinct or 0, n_train or 0
    plain = lexicon.select("word", "c").where("c > 0")
    junctions = written(block_junctions(blocks).groupBy("key").agg(F.sum("c").alias("c")), "junctions")
    n_junctions = junctions.count()
    tables = context_tables(plain, n_all, junctions, n_junctions)
    model = docs.sparkSession.sparkContext.broadcast(
        (tables, *mixing_weights(plain, n_all, junctions, n_junctions, tables)))
    scores = written(word_scores(lexicon, n_all, model, shares), "words")
    starts, masses, prior = class_masses(scores, shares)
    per_block = words.select("block", "id", "word").join(scores, "word").select(
        "block", F.col("id").cast("int").alias("id"), "c", "logp", "belongs", "ends")
    divisor = n_train + 0.5 * (n_distinct + 1)
    kind = docs.schema["doc_id"].dataType

    def run(documents, entries):
        import numpy as np

        _, _, score = model_code()
        order = np.argsort(entries["id"].to_numpy())
        c, logp = entries["c"].to_numpy()[order], entries["logp"].to_numpy().astype(float)[order]
        ends = entries["ends"].to_numpy()[order]
        codes = ends & 0xFFFFFF, ends >> 24 & 0xFFFFFF, ends >> 48 > 0
        base = np.log10((c + 0.5) / divisor)
        tilt = _shares(entries["belongs"].to_numpy()[order])
        tilt[c == 0] = prior
        mass = np.tile(prior, (len(ends), 1))
        if len(starts):
            at = np.minimum(np.searchsorted(starts, codes[0]), len(starts) - 1)
            mass = np.where((starts[at] == codes[0])[:, None], masses[at], mass)
        tilt /= mass
        np.log10(tilt, out=tilt)
        del entries, order, ends, mass
        n_tokens, n_bytes = documents["n_tokens"].to_numpy(), documents["n_bytes"].to_numpy()
        out, (_, unpack) = [], packed_numbers()
        end = np.nonzero(codes[0] == END[0] << 16)[0]
        texts = []
        for k in range(0, len(documents), TEXTS):
            ids = unpack(b"".join(documents["a"].iloc[k:k + TEXTS]))
            keys, which = np.unique(junction_keys(ids, *codes, end), return_inverse=True)
            texts.append((ids.astype(np.int32), keys, which.astype(np.int32)))
        met = np.unique(np.concatenate([np.zeros(0, np.int64), *(keys for _, keys, _ in texts)]))
        joined = score(met, np.zeros(len(met)), *model.value)
        for k, (ids, keys, which) in enumerate(texts):
            some = slice(k * TEXTS, (k + 1) * TEXTS)
            at = np.cumsum(n_tokens[some]) - n_tokens[some]
            by_class = np.add.reduceat(tilt[ids], at) + np.log10(shares)
            best = by_class.max(1)
            tokens = np.add.reduceat(logp[ids] + joined[np.searchsorted(met, keys)][which], at)
            total = tokens + best + np.log10((10 ** (by_class - best[:, None])).sum(1))
            out.append(np.stack([np.add.reduceat((c[ids] > 0).astype(float), at), np.add.reduceat(base[ids], at), total,
                                 -total / np.log10(2) / n_bytes[some]]))
        known, base_sum, total, bits = np.concatenate(out, axis=1) if out else np.zeros((4, 0))
        return documents[["doc_id", "held_out", "n_tokens"]].assign(
            n_known=known.astype(np.int64), train_tokens=n_train, base_score=base_sum, score=total, bits_per_byte=bits)

    rows = blocks.where("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "n_bytes", "a").groupBy("block").cogroup(
        per_block.groupBy("block")).applyInPandas(
        run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double, bits_per_byte double")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))
