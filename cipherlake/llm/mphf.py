"""Minimal perfect hashing of 64-bit keys, vectorised: cascaded collision-free bit levels with rank."""

from __future__ import annotations

import io

import numpy as np

from cipherlake.llm.common import mix

#: Keys of one bucket on average; each bucket has its own function, so building and loading stay small.
BUCKET = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, by other bits than those used inside a bucket."""
    with np.errstate(over="ignore"):
        return ((mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(level + 1) * _STEP) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Maps n distinct keys to 0 .. n - 1 in constant expected time; other keys map to -1 or to any slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.rank = np.cumsum(bits) - bits

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 1.6) -> "MinimalPerfectHash":
        levels, rest = [], keys
        while len(rest):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, int(load * len(rest)))
            at = _slot(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _slot(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.rank[base + at[hit]]
            open_, base = open_[~hit], base + len(bits)
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        bits = np.concatenate(self.levels) if self.levels else np.zeros(0, bool)
        return {"sizes": np.array([len(x) for x in self.levels], np.int64), "bits": np.packbits(bits)}

    @classmethod
    def of_arrays(cls, sizes: np.ndarray, bits: np.ndarray) -> "MinimalPerfectHash":
        flat = np.unpackbits(bits)[: int(sizes.sum())].astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])


def pack_index(keys: np.ndarray, starts: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    """An index file: the hash of distinct keys, each key's fingerprint, and its rows of the columns (rows starts[i] up to starts[i + 1])."""
    f = MinimalPerfectHash.build(keys)
    slot = f.lookup(keys)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    n = np.diff(starts)[order]
    ends = np.cumsum(n)
    take = np.repeat(starts[:-1][order] - (ends - n), n) + np.arange(int(n.sum()))
    out = io.BytesIO()
    np.savez(out, **f.arrays(), fingerprint=fingerprints(keys)[order], starts=np.concatenate([[0], ends]), **{f"c_{k}": v[take] for k, v in columns.items()})
    return out.getvalue()


class Index:
    """Keyed access to an index file."""

    def __init__(self, data: bytes):
        z = np.load(io.BytesIO(data))
        self.hash = MinimalPerfectHash.of_arrays(z["sizes"], z["bits"])
        self.fingerprint, self.starts = z["fingerprint"], z["starts"]
        self.columns = {k[2:]: z[k] for k in z.files if k.startswith("c_")}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(place of the key of each found row, its columns); keys that the stored fingerprint refutes have no row."""
        slot = self.hash.lookup(keys)
        good = slot >= 0
        good[good] = self.fingerprint[slot[good]] == fingerprints(keys[good])
        at, slot = np.flatnonzero(good), slot[good]
        n = self.starts[slot + 1] - self.starts[slot]
        ends = np.cumsum(n)
        take = np.repeat(self.starts[slot] - (ends - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), {k: v[take] for k, v in self.columns.items()}
