"""PartEnum signatures of shingle sets: the array kernels, without Spark.

Sets are sorted arrays of distinct 64-bit shingle hashes. Two sets x, y with Jaccard similarity of at
least 3/4 differ in at most (|x| + |y|) / 7 features, and the larger is at most 4/3 as large as the
smaller. Sizes are cut into bands of that ratio, so similar sets lie in the same or in adjacent bands;
a set takes part in the instance of its own band and in the next one's.

An instance partitions the feature domain by a hash into m parts. A set x with at most k differences to
any partner signs its first k + 1 parts that hold a feature: at most k of these can differ, so one is
equal, and the partner signs it as well. (The enumerated subsets of parts are the singletons; m is
chosen so that a part holds two or three features.) A set with too few parts that hold a feature signs
all parts, empty ones included.

Leaving out the same features from all sets lowers no bound, as it can only remove differences. So a
second domain leaves out `stop` shingles, which many documents share; sets that keep too few features
there, and all sets that could be similar to such a set, sign in the whole domain (RARE).
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)
#: Sets of more features have a long sketch.
LONG = 256
#: Bytes of sketches that are compared at once.
APART_BYTES = 2_000_000
#: Parts for each feature of the band's largest set, in the whole domain and in that without stop shingles.
PARTS_WHOLE, PARTS_RARE = 0.36, 0.8
#: Sets that keep a smaller share of their features without the stop shingles sign in the whole domain alone.
RARE = 0.42


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text. ASCII letters in lower case; words are parted by ASCII white space alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
    if n < WORDS:
        return mix((h * _ODD[:n]).sum(keepdims=True, dtype=U) + U(WORDS - n))
    m = n - WORDS + 1
    s = h[:m] * _ODD[0]
    for i in range(1, WORDS):
        s += h[i : i + m] * _ODD[i]
    return np.unique(mix(s))


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set: equal sets are one class."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _bounds() -> np.ndarray:
    out, x = [1], 1
    while x < 1 << 40:
        x = max(x + 1, -(-4 * x // 3))
        out.append(x)
    return np.array(out, dtype=np.int64)


#: Band i holds sizes from BOUNDS[i] up to, without, BOUNDS[i + 1] <= 4/3 of it, rounded up.
BOUNDS = _bounds()


def _signed(s: np.ndarray, n: int, band: int, share: float, tag: int) -> np.ndarray:
    """The signatures of s, of a set of n features, in one instance."""
    top = int(BOUNDS[band + 1])
    k = (n + min(top - 1, 4 * n // 3)) // 7
    m = int(share * top) + 2
    seed = U((band * 4 + tag) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    h = mix(s ^ seed)
    part = ((h >> U(32)) * U(m)) >> U(32)
    order = np.argsort(part, kind="stable")
    part, h = part[order], h[order]
    if len(h):
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        used, sums = part[starts], np.add.reduceat(mix(h + U(1)), starts)
    else:
        used, sums = part, h
    if len(used) > k:
        used, sums = used[: k + 1], sums[: k + 1]
    else:
        full = np.zeros(m, U)
        full[used.astype(np.int64)] = sums
        used, sums = np.arange(m, dtype=U), full
    return mix(sums + mix(used * U(0x9FB21C651E98DF25) + seed))


def rare_part(s: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """s without the stop shingles. stop: their sorted hashes."""
    if not len(stop):
        return s
    at = np.minimum(np.searchsorted(stop, s), len(stop) - 1)
    return s[stop[at] != s]


def signatures(s: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set, and a flag for each. Two sets need a comparison where they share a signature
    that one of them flags: unflagged are those in the whole domain of sets that sign in both domains."""
    n = len(s)
    if not n:
        return np.empty(0, U), np.empty(0, bool)
    band = int(np.searchsorted(BOUNDS, n, "right")) - 1
    rare, out = rare_part(s, stop), []
    if own := len(rare) >= RARE * n:
        out += [_signed(rare, n, b, PARTS_RARE, 1) for b in (band, band + 1)]
    first = sum(map(len, out))
    # A partner that signs in the whole domain alone has less than RARE * 4/3 * n rare features, and lacks
    # at most a quarter of this set.
    if len(rare) < RARE * n * 4 / 3 + n / 4 + 1:
        out += [_signed(s, n, b, PARTS_WHOLE, 0) for b in (band, band + 1)]
    sigs = np.concatenate(out)
    flags = np.ones(len(sigs), bool)
    flags[first:] = not own
    return sigs, flags


def group_signatures(s: np.ndarray, stop: np.ndarray, group: int) -> np.ndarray:
    """Signatures of a set among the members of one group, without the group's `stop` shingles."""
    band, seed = int(np.searchsorted(BOUNDS, len(s), "right")) - 1, mix(np.array([group], np.int64).view(U))
    rare = rare_part(s, stop) ^ seed
    return np.unique(mix(np.concatenate([_signed(rare, len(s), b, PARTS_RARE, 2) for b in (band, band + 1)]) ^ seed))


def sketch(s: np.ndarray, bits: int = 512) -> np.ndarray:
    """The parity of the number of features in each of `bits` classes, as words: the bits in which two sketches
    differ are no more than the features in which the sets differ."""
    odd = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def long_sketch(s: np.ndarray) -> bytes | None:
    """A sketch with two to four bits for each feature of a set of over LONG features: few features share one."""
    return sketch(s, 1 << (2 * len(s) - 1).bit_length()).tobytes() if len(s) > LONG else None


def folded(sketches: list[bytes]) -> np.ndarray:
    """The short sketches (rows of 8 words) of sketches of any length: classes are merged until 512 are left."""
    out, groups = np.zeros((len(sketches), 8), U), {}
    for i, x in enumerate(sketches):
        groups.setdefault(len(x), []).append(i)
    for own in groups.values():
        x = np.frombuffer(b"".join(sketches[i] for i in own), U).reshape(len(own), -1)
        while x.shape[1] > 8:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[own] = x
    return out


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each pair, the bits in which two long sketches differ; the classes of the larger one are merged to
    those of the other. Pairs of the same two lengths are compared at once."""
    out, groups = np.zeros(len(a), np.int64), {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        groups.setdefault((len(x), len(y)), []).append(i)
    for own in groups.values():
        step = max(1, APART_BYTES // max(len(a[own[0]]), len(b[own[0]])))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            x, y = (np.frombuffer(b"".join(z[i] for i in part), U).reshape(len(part), -1) for z in (a, b))
            while x.shape[1] != y.shape[1]:
                if x.shape[1] < y.shape[1]:
                    x, y = y, x
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out
