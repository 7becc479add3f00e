"""The bit counts behind SimHash, for tasks that read text."""

from __future__ import annotations


def bit_votes():
    """``votes(hashes)``: for a uint64 array, how many have each bit set, lowest bit first.

    A histogram of each byte is multiplied by the bits of the 256 byte values, so
    the cost is eight table look-ups a hash.
    """
    import numpy as np

    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def votes(hashes):
        columns = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        return np.concatenate([np.bincount(columns[:, i], minlength=256) @ bits for i in range(8)])

    return votes


def shingle_fingerprints(n: int = 3, seed: int = 42, chunk: int = 1 << 20):
    """``fingerprint(text)`` -> int: bit set if set in over half of the XXH64 of all ``n``-word shingles.

    A-Z are lower-cased and words are split at ASCII white space.  With fewer
    than ``n`` words the whole sequence is the one shingle; without words the
    fingerprint is 0.  Hashes are counted ``chunk`` at a time, so memory
    beyond the text is bounded.
    """
    import numpy as np
    import xxhash

    votes, digest = bit_votes(), xxhash.xxh64_intdigest
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def fingerprint(text):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return 0
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(n, len(words))
        first, last = starts[: len(words) - k + 1], ends[k - 1:]
        count, total = len(first), np.zeros(64, np.int64)
        for at in range(0, count, chunk):
            pairs = zip(first[at:at + chunk].tolist(), last[at:at + chunk].tolist())
            total += votes(np.fromiter([digest(joined[a:b], seed) for a, b in pairs], np.uint64))
        return int(powers[2 * total > count].sum(dtype=np.uint64))

    return fingerprint
