"""Elias-Fano sequences in memory-mapped files, searched many values at a time."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyarrow.fs import FileSystem, FileType

from sparrowlake.llm.common import U64


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The position of the set bit number r (from 0) in each word."""
    at, r = np.zeros(len(word), np.int64), r.astype(np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        low = word & U64((1 << s) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = r >= count
        r = np.where(up, r - count, r)
        word = np.where(up, word >> U64(s), low)
        at += np.where(up, s, 0)
    return at


class EliasFano:
    """A sequence that never falls: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros
        self.buckets = len(high) * 64 - n  # as many zeros as there are

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of the sequence."""
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            at, part = np.arange(n, dtype=U64) * U64(bits), values & U64((1 << bits) - 1)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            np.bitwise_or.at(low, word + 1, (part >> U64(1)) >> (U64(63) - shift))
        length = (top >> bits) + n + 2
        marks = np.zeros(-(-length // 64) * 64, np.uint8)
        marks[(values >> U64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(U64)
        ones = np.cumsum(np.bitwise_count(high).astype(np.int64)) - np.bitwise_count(high)
        # both directories are stored, so an opened sequence holds no memory but the mapped file
        return {"shape": np.array([n, bits], np.int64), "low": low, "high": high, "ones": ones, "zeros": np.arange(len(ones), dtype=np.int64) * 64 - ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, bits = (int(x) for x in arrays[f"{name}.shape"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"], arrays[f"{name}.zeros"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << U64(1)) << (U64(63) - shift))) & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the positions."""
        w = np.searchsorted(self.ones, i, "right") - 1
        at = w * 64 + _in_word(self.high[w], i - self.ones[w])
        return ((at - i).astype(U64) << U64(self.bits)) | self._low(i)

    def _below(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits under ``bucket``."""
        j = np.maximum(bucket - 1, 0)
        w = np.searchsorted(self.zeros, j, "right") - 1
        at = w * 64 + _in_word(~self.high[w], j - self.zeros[w])
        return np.where(bucket == 0, 0, at - j)

    def find(self, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The position of each value in its range [a, b), or -1: the bucket of its high bits is cut to the range, and the successor of its low bits is sought there."""
        v = v.astype(U64)
        if not self.n or not len(v):
            return np.full(len(v), -1, np.int64)
        bucket = (v >> U64(self.bits)).astype(np.int64)
        inside = bucket < self.buckets - 1
        bucket = np.where(inside, bucket, 0)
        lo, hi = np.maximum(a, self._below(bucket)), np.minimum(b, self._below(bucket + 1))
        end, want = hi, v & U64((1 << self.bits) - 1)
        lo, hi = lo.copy(), np.maximum(lo, hi)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo[less]], hi[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        ok = inside & (lo < end)
        at = np.where(ok, lo, 0)
        return np.where(ok & (self._low(at) == want), at, -1)


def _mounted(folder: str) -> str | None:
    """The path of a folder that can be opened like any file, else None."""
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays into one file of the folder, each at a multiple of 64 bytes, and put it in place in one step, so that a task run again does no harm."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [str(v.dtype), len(v), at]
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    part = f"{name}.{uuid.uuid4().hex}"

    def write(f) -> None:
        f.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes())
            f.write(b"\0" * (-v.nbytes % 64))

    if root := _mounted(folder):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{part}", "wb") as f:
            write(f)
        os.replace(f"{root}/{part}", f"{root}/{name}")
        return
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/{os.path.dirname(name)}", recursive=True)
    with fs.open_output_stream(f"{root}/{part}") as f:
        write(f)
    if fs.get_file_info(f"{root}/{name}").type == FileType.File:  # a task that ran before has put the same there
        fs.delete_file(f"{root}/{part}")
    else:
        fs.move(f"{root}/{part}", f"{root}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and not read; a file that is not mounted is copied into the node's own folder once."""
    if not (root := _mounted(folder)):
        root = f"{tempfile.gettempdir()}/levels-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        if not os.path.exists(f"{root}/{name}"):
            fs, far = FileSystem.from_uri(folder)
            os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
            part = f"{root}/{name}.{uuid.uuid4().hex}"
            with fs.open_input_stream(f"{far}/{name}") as f, open(part, "wb") as out:
                shutil.copyfileobj(f, out)
            os.replace(part, f"{root}/{name}")
    data = np.memmap(f"{root}/{name}", np.uint8, "r")
    size = int(data[:8].view(np.int64)[0])
    head = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for k, (kind, n, at) in head.items():
        out[k] = data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind).view(np.ndarray)
    return out


def named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}
