"""BPE encoding and decoding with a pair occurrence index.

A block of texts is cut into chunks at single spaces and single line ends between two
characters that are not white space; no pre-token crosses such a place, so a chunk is
encoded once and remembered. The new chunks of a block are split into pre-tokens by the byte-level
pattern, and all their symbols form one sequence with links to the neighbours. An
index maps each pair of adjacent symbols that has a merge to all its positions; the
ranks that have positions wait in a heap and are applied in ascending order to all
positions at once, and each merge updates the lists of the two pairs it makes.

Merging rank by rank gives each word's result in the defined order (lowest rank
first, leftmost first) because no merge makes a pair of a lower or equal rank than
its own: each token is made by one merge, and the merges that use it come later.
``Model`` verifies this for the file it loads.

Nulls: a null text encodes as an empty one (no ids); null ids decode to the empty
text. Columns of the input that are named as an output are replaced. Very long texts
are one row each; a block is cut by bytes, so that memory does not follow the number
of rows in a batch. Repeated rows and ties are encoded alike; an empty table gives an
empty table. The special token's literal is recognised in a text, as the tokenizers
library does unless told otherwise.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparrowlake.llm.common import add_columns

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: So many chunks, or characters of them, are remembered in each of two generations.
MEMO_CHUNKS, MEMO_CHARS = 120_000, 8_000_000
_SPACE, _LINE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")


def cut(text: str) -> list[str]:
    """The chunks of a text: a single space between two characters that are not white space begins one, and such a line end is one."""
    mark = "\0" if "\0" not in text else "\udfff"  # a lone surrogate is in no text
    return _LINE.sub(f"{mark}\n{mark}", _SPACE.sub(f"{mark} ", text)).split(mark)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(0x100 + next(rest)) for b in range(256)]


class Model:
    """Vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, symbols = j["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.of_byte = np.array([vocab[c] for c in symbols], np.int64)
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.base = len(self.bytes)
        pairs = []
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if made.get(x, -1) >= r or made.get(y, -1) >= r or z in made:
                raise ValueError(f"merge {r} can be made possible by a later one; ranks can't be applied in ascending order")
            made[z] = r
            pairs.append(x * self.base + y)
            self.merges.append((x, y, z))
        self.key_ranks = np.argsort(np.array(pairs, np.int64))
        self.keys = np.array(pairs, np.int64)[self.key_ranks]
        self.pattern = regex.compile(PATTERN)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair (left * base + right), or -1."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.key_ranks[at], -1)

    def encode_words(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and how many each has, through one pair occurrence index over all of them."""
        sym = self.of_byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        n = len(sym)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        starts = np.cumsum(size) - size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[starts] = -1
        after[starts + size - 1] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray, pairs: np.ndarray) -> None:
            """Put the positions into the lists of their pairs; a pair that had none becomes active."""
            r = self.ranks(pairs)
            known = np.flatnonzero(r >= 0)
            if not len(known):
                return
            r, positions = r[known], positions[known]
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                r, positions = r[order], positions[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for k, (i, j) in zip(r[cuts[:-1]].tolist(), zip(cuts, cuts[1:])):
                if k in where:
                    where[k].append(positions[i:j])
                else:
                    where[k] = [positions[i:j]]
                    heapq.heappush(active, k)

        first = np.flatnonzero(after >= 0)
        add(first, sym[first] * self.base + sym[after[first]])
        while active:
            r = heapq.heappop(active)
            left, right, new = self.merges[r]
            p = where.pop(r)
            p = p[0] if len(p) == 1 else np.unique(np.concatenate(p))
            q = after[p]
            ok = (sym[p] == left) & (q >= 0) & (sym[q] == right)
            p, q = p[ok], q[ok]
            if left == right and len(p) > 1:  # in a run of one symbol every other place counts, from the left
                keep, last = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x != last:
                        keep.append(i)
                        last = y
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            sym[p], sym[q] = new, -1
            far, near = after[q], before[p]
            after[p] = far
            has = far >= 0
            far, left_of = far[has], p[has]
            before[far] = left_of
            has = near >= 0
            near = near[has]
            # a neighbour on the left may itself have been merged now: then it is that place's first symbol, which still stands
            add(np.concatenate([left_of, near]), np.concatenate([new * self.base + sym[far], sym[near] * self.base + new]))
        alive = sym >= 0
        counts = np.add.reduceat(alive.astype(np.int64), starts) if n else np.zeros(0, np.int64)
        return sym[alive].astype(np.int32), counts

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` with these numbers, one after the other."""
    size = length[numbers]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[numbers] - (ends - size), size)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class ChunkMemo:
    """Chunk to its number in the tables ``start`` and ``length`` of the flat ``ids``; ``old`` is the memory before this one."""

    def __init__(self, encode_chunks, old: "ChunkMemo | None" = None) -> None:
        self.encode_chunks, self.old, self.number = encode_chunks, old, {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.odd = np.zeros(1 << 16, bool)
        self.used = self.chars = 0

    def __len__(self) -> int:
        return len(self.number)

    def _put(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.number)
        first = n - len(counts)
        self.flat, self.start, self.length, self.odd = _room(self.flat, self.used + len(ids)), *(_room(x, n) for x in (self.start, self.length, self.odd))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[first:n], self.start[first:n] = counts, self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _name(self, chunks: list[str]) -> None:
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        self.chars += sum(map(len, chunks))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each of the distinct chunks; those that are new come from the old memory, or are encoded."""
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.flatnonzero(found < 0)
        new = [chunks[i] for i in at.tolist()]
        if self.old is not None and new:
            held = np.fromiter(map(self.old.number.get, new, repeat(-1)), np.int64, len(new))
            known = held >= 0
            names, numbers = list(compress(new, known)), held[known]
            found[at[known]] = np.arange(len(self), len(self) + len(names))
            self._name(names)
            self._put(self.old.gather(numbers), self.old.length[numbers])
            self.odd[len(self) - len(names) : len(self)] = self.old.odd[numbers]
            at, new = at[~known], list(compress(new, ~known))
        if new:
            found[at] = np.arange(len(self), len(self) + len(new))
            self._name(new)
            self._put(*self.encode_chunks(new))
            # empty ones, and those that begin (after a space) or end with white space, can't be taken as they are
            self.odd[len(self) - len(new) : len(self)] = [c != "\n" and len(c.strip() or "  ") != len(c) - (c[:1] == " ") for c in new]
        return found

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start, self.length, numbers)


class BlockEncoder:
    """Ids of whole texts, by chunks; ``encode_chunks`` gives the ids of a list of chunks.

    The chunks used last are remembered in two generations of ``memo_chunks`` chunks (or
    ``MEMO_CHARS`` characters): a full one becomes the old one, and what is used again
    moves from there to the new one, so the commonest chunks are not encoded again.
    """

    def __init__(self, encode_chunks, special: dict[str, int], cut_special, memo_chunks: int = MEMO_CHUNKS) -> None:
        self.special, self.cut_special, self.memo_chunks = special, cut_special, memo_chunks
        self.memo = ChunkMemo(encode_chunks)

    def _careful(self, text: str) -> np.ndarray:
        """The ids of a text that may hold special tokens, NUL, or more white space than single spaces and line ends."""
        out = []
        for i, piece in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
            if i % 2:
                out.append(np.array([self.special[piece]], np.int32))
            elif piece:
                chunks = cut(piece)
                place = dict(zip(dict.fromkeys(chunks), range(len(chunks))))
                out.append(self.memo.gather(self.memo.numbers(list(place))[[place[c] for c in chunks]]))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        t = pc.fill_null(texts.cast(pa.large_string()), "")
        care = np.zeros(len(t), bool)
        for s in ("\0", *self.special):
            care |= pc.match_substring(t, s).to_numpy(zero_copy_only=False)
        # every space and line end is taken as a cut first; texts where one has white space beside it are cut again with care
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(t, " ", "\0 "), "\n", "\0\n\0"), "\0")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        found = lists.flatten().dictionary_encode()
        numbers = self.memo.numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
        care |= np.logical_or.reduceat(self.memo.odd[numbers], ends[:-1])
        upto = np.concatenate([[0], np.cumsum(self.memo.length[numbers])])
        ids, counts = self.memo.gather(numbers), upto[ends[1:]] - upto[ends[:-1]]
        if care.any():
            parts = [self._careful(t[i].as_py()) if care[i] else ids[upto[ends[i]] : upto[ends[i + 1]]] for i in range(len(t))]
            ids, counts = np.concatenate(parts), np.array([*map(len, parts)], np.int64)
        if len(self.memo) > self.memo_chunks or self.memo.chars > MEMO_CHARS:
            self.memo.old = None
            self.memo = ChunkMemo(self.memo.encode_chunks, self.memo)
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encode_block(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def _index_chunks(model: Model):
    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        plan, sizes = [], []
        for c in chunks:
            found = model.pattern.findall(c)
            sizes.append(len(found))
            plan += [number.setdefault(p, len(number)) for p in found]
        if not plan:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        flat, counts = model.encode_words([p.encode() for p in number])
        plan = np.array(plan, np.int64)
        ids = gather(flat, np.cumsum(counts) - counts, counts, plan)
        ends = np.cumsum([0, *sizes])
        upto = np.concatenate([[0], np.cumsum(counts[plan])])
        return ids, upto[ends[1:]] - upto[ends[:-1]]

    return encode_chunks


@lru_cache(maxsize=2)
def block_encoder(path: str) -> BlockEncoder:
    """One encoder a worker process, so that its memory of chunks serves all the tasks that the process runs."""
    m = load(path)
    return BlockEncoder(_index_chunks(m), m.special, m.cut_special)


def ends_of(counts: np.ndarray) -> np.ndarray:
    """Where each of the lists that lie one after the other begins, and the last one ends; 32 bits, as Arrow's lists have."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    if ends[-1] >= 1 << 31:
        raise ValueError("one slice of texts makes more ids than an Arrow array holds")
    return ends.astype(np.int32)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends_of(counts)), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole ``text`` as an array column."""

    def make():
        enc = block_encoder(path)
        return lambda texts: [id_lists(*enc.encode_block(texts))]

    return add_columns(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends_of(4 * counts)), pa.py_buffer(ids.astype("<u4"))])


def _decoder(path: str):
    m = load(path)

    def of(found) -> str:
        try:
            return m.decode(found)
        except (IndexError, TypeError):
            return m.decode([i for i in found if i is not None and 0 <= i < len(m.bytes)])

    return of


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that each list of ids stands for; bytes that are not UTF-8 become U+FFFD, ids outside the vocabulary nothing."""

    def make():
        of = _decoder(path)
        return lambda lists: [pa.array([of(x or []) for x in lists.to_pylist()], pa.string())]

    return add_columns(df, ids, [T.StructField(decoded, T.StringType())], make)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` with the ids packed into a binary column, and ``decode`` of just those bytes, in one pass over the texts."""

    def make():
        enc, of = block_encoder(path), _decoder(path)

        def both(texts: pa.Array) -> list[pa.Array]:
            held = packed(*enc.encode_block(texts))
            return [held, pa.array([of(np.frombuffer(x.as_py(), "<u4").tolist()) for x in held], pa.string())]

        return both

    return add_columns(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], make)
