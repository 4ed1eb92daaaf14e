"""Byte-level BPE encoding by a pair occurrence index, and decoding.

The texts of a partition are cut, block by block, into pieces as the tokenizer file says; distinct pieces
are kept once, their symbols one after the other in one array with links to the neighbours. An index maps
each pair that has a rank to all positions where it occurs in the block. The active ranks are applied in
ascending order, each to all its positions at once: the pair becomes one symbol, and only the pairs with
its two neighbours are entered anew, under their ranks. That equals merging each piece by itself, as a
vocabulary whose merges only use earlier products never gives a new pair a lower rank (files are checked
for that). The ids of the pieces are then laid out text by text.

A block costs its bytes plus a little for each active rank, whatever the length of a text or a piece.
"""

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W

BLOCK = 4 << 20  # bytes of text
JOINED = 1 << 16  # bytes of distinct chunks that are cut in one call
IDS = np.dtype("<u4")

# Fixed values of byte-level files: bytes that stand for themselves, as first and last one of each range.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
OTHERS_FROM = 0x100  # characters of all other bytes, in ascending order

NO_RANK = np.iinfo(np.int32).max
GONE = -2


def byte_letters() -> list:
    """The character that stands for each byte."""
    printable = [any(low <= b <= high for low, high in PRINTABLE) for b in range(256)]
    others = iter(range(OTHERS_FROM, OTHERS_FROM + 256))
    return [chr(b) if printable[b] else chr(next(others)) for b in range(256)]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. of each run of `size`, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


def borders_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def binaries(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The stretches of `data` between neighbouring borders."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, buffers)


class BytePairs:
    """A byte-level BPE tokenizer file: merges by rank, the bytes of each id, and its special tokens."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, cutter = described["model"], described["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
        if described["normalizer"] or not (plain and byte_level) or cutter.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self._read_merges(model, path)
        self._read_specials(described["added_tokens"], path)

    def _read_merges(self, model: dict, path: str):
        vocabulary, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = set(letters)
        for left, right in pairs:
            if left not in made or right not in made:
                raise ValueError(f"{path}: {left} {right} is merged before its parts")
            made.add(left + right)
        self.byte_ids = np.array([vocabulary[c] for c in letters], np.int32)
        ids = np.array([[vocabulary[a], vocabulary[b], vocabulary[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)
        self.left, self.right, self.product = (ids[:, i].astype(np.int32) for i in range(3))
        keys = ids[:, 0] << 32 | ids[:, 1]
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.contents = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocabulary.items()}

    def _read_specials(self, tokens: list, path: str):
        self.specials = {}
        for token in tokens:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"{path}: special token {token['content']} takes its surroundings")
            self.specials[token["content"].encode()] = token["id"]
            self.contents[token["id"]] = token["content"].encode()
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, longest)))
        size = max(self.contents) + 1
        lengths = np.array([len(self.contents.get(i, b"")) for i in range(size)], np.int64)
        self.token_data = np.frombuffer(b"".join(self.contents.get(i, b"") for i in range(size)), np.uint8)
        self.token_first, self.token_size = np.cumsum(lengths) - lengths, lengths

    # --- merging ----------------------------------------------------------------------------------

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merged(self, data: np.ndarray, borders: np.ndarray) -> tuple:
        """(ids of all pieces one after the other, border of each piece) by the pair occurrence index."""
        n = len(data)
        symbol = np.append(self.byte_ids[data], np.int32(GONE))  # the last place stands for "no neighbour"
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = borders[1:] > borders[:-1]
        after[borders[1:][filled] - 1] = n
        before[borders[:-1][filled]] = n
        index, active = {}, []

        def enter(places: np.ndarray):
            found = self.rank(symbol[places], symbol[after[places]])
            kept = found != NO_RANK
            found, places = found[kept], places[kept]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            for rank, part in zip(found[starts].tolist(), np.split(places, starts[1:]), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        if n and len(self.keys):
            enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            places = np.sort(np.concatenate(index.pop(rank)))
            places = places[np.append(True, places[1:] != places[:-1])]
            left, right = self.left[rank], self.right[rank]
            second = after[places]
            valid = (symbol[places] == left) & (symbol[second] == right)
            places, second = places[valid], second[valid]
            if left == right and len(places) > 1:  # of overlapping pairs every other one, from the left
                begins = np.append(True, places[1:] != second[:-1])
                since = np.arange(len(places)) - np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                places, second = places[since % 2 == 0], second[since % 2 == 0]
            symbol[places] = self.product[rank]
            symbol[second] = GONE
            third = after[second]
            after[places] = third
            before[third] = places
            earlier = before[places]
            enter(np.concatenate([earlier[earlier != n], places]))
        left_over = symbol[:-1] != GONE
        return symbol[:-1][left_over], borders_of(left_over)[borders]

    # --- texts ------------------------------------------------------------------------------------

    def chunk_borders(self, texts: pa.Array, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Borders of chunks, which are cut into pieces on their own: an end of a text or of a special token, or
        a blank after a character that is certainly none."""
        blank = ~W.SOLID[data]
        certain = (data >= 0x21) & (data <= 0x7E)
        certain[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        border = np.zeros(len(data) + 1, dtype=bool)
        border[1:-1] = blank[1:] & certain[:-1]
        border[borders] = True
        for token in self.specials:
            rows = pc.indices_nonzero(pc.match_substring(texts, token.decode())).to_numpy()
            for row in rows:
                spans = self.special.finditer(data[borders[row] : borders[row + 1]].tobytes())
                for span in spans:
                    border[borders[row] + np.array(span.span())] = True
        return np.flatnonzero(border)

    def piece_sizes(self, chunks: list) -> list:
        """Per chunk, the number of bytes of each of its pieces."""
        out, joined, size = [None] * len(chunks), [], 0

        def cut_joined():
            if not joined:
                return
            sizes = [len(piece) for piece, _ in self.cut(b"".join(chunks[i] for i in joined).decode())]
            at = 0
            for i in joined:
                begin, left = at, len(chunks[i])
                while left:
                    left -= sizes[at]
                    at += 1
                out[i] = sizes[begin:at]

        for i, chunk in enumerate(chunks):
            inside = chunk[0] < 0x80 and not W.SOLID[chunk[0]] and 0x21 <= chunk[-1] <= 0x7E
            if chunk in self.specials:
                out[i] = [len(chunk)]
            elif not inside:  # at a text's start or end, or after a letter beyond ASCII
                out[i] = [len(piece) for piece, _ in self.cut(chunk.decode())]
            else:
                joined.append(i)
                size += len(chunk)
                if size >= JOINED:
                    cut_joined()
                    joined, size = [], 0
        cut_joined()
        return out

    def encode(self, texts: pa.Array) -> tuple:
        """(ids of all texts one after the other, border of each text) of a column without nulls."""
        data, borders = W.flat(texts)
        at = self.chunk_borders(texts, data, borders)
        if len(at) < 2:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = binaries(data, at).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        sizes = self.piece_sizes(chunks)
        pieces_in = np.array([len(s) for s in sizes], np.int64)
        piece_at = borders_of(np.fromiter((size for s in sizes for size in s), np.int64, int(pieces_in.sum())))
        pieces = binaries(np.frombuffer(b"".join(chunks), np.uint8), piece_at).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary
        ids, id_at = self.merged(*flat_binaries(distinct))
        for token, number in self.specials.items():
            place = pc.index(distinct, pa.scalar(token, pa.large_binary())).as_py()
            if place >= 0:  # cut out above, so it never is ordinary text
                ids, id_at = replaced(ids, id_at, place, number)
        # ids of pieces, then of chunks, then of texts
        first, size = id_at[:-1][which], np.diff(id_at)[which]
        chunk_ids = ids[runs(first, size)]
        chunk_at = borders_of(size)[borders_of(pieces_in)]
        used = coded.indices.to_numpy()
        first, size = chunk_at[:-1][used], np.diff(chunk_at)[used]
        return chunk_ids[runs(first, size)], borders_of(size)[np.searchsorted(at, borders)]

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> tuple:
        """(bytes of all ids one after the other, border of each text); an id that the file lacks raises."""
        if len(ids) and int(ids.max()) >= len(self.token_size):
            raise ValueError(f"id {int(ids.max())} is not in the tokenizer")
        size = self.token_size[ids]
        return self.token_data[runs(self.token_first[ids], size)], borders_of(size)[borders]


def flat_binaries(values: pa.Array) -> tuple:
    """All bytes of a binary column without nulls, and the border of each value in them."""
    return W.flat(values.cast(pa.large_binary()))


def replaced(ids: np.ndarray, borders: np.ndarray, place: int, number: int) -> tuple:
    """The run at `place` becomes the single id `number`."""
    low, high = borders[place], borders[place + 1]
    moved = borders.copy()
    moved[place + 1 :] += 1 - (high - low)
    return np.concatenate([ids[:low], [np.int32(number)], ids[high:]]), moved


FILES: dict = {}


def byte_pairs(path: str) -> BytePairs:
    """One table for each file and worker, kept between tasks."""
    if path not in FILES:
        FILES[path] = BytePairs(path)
    return FILES[path]


def with_columns(batch: pa.RecordBatch, keep: list, row: int, rows: int, columns: dict) -> pa.RecordBatch:
    kept = {name: batch.column(name).slice(row, rows) for name in keep}
    return pa.RecordBatch.from_pydict(kept | columns)


def fields_of(docs: DataFrame, keep: list) -> list:
    return [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep]


def encoded(docs: DataFrame, path: str, keep=("doc_id",), text: str = "text", back: str = None) -> DataFrame:
    """The columns `keep`, n_tokens, and ids: token ids as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library for the file at `path` without added special tokens; a special
    token's string in a text is that token. `back` names a column for the text decoded from these ids, block by
    block in the same worker. Null texts are empty and have no ids. Repeated rows and equal keys are encoded row
    by row, an empty table gives no rows, other columns are not read. A text of any length is one block at most;
    no row is moved.
    """
    keep = list(keep)

    def encode(batches):
        tokenizer = byte_pairs(path)
        for batch in batches:
            for row, part in W.pieces(W.filled(batch.column("_text")), BLOCK):
                ids, borders = tokenizer.encode(part)
                made = {
                    "n_tokens": pa.array(np.diff(borders)),
                    "ids": binaries(ids.astype(IDS).view(np.uint8), borders * IDS.itemsize).cast(pa.binary()),
                }
                if back:
                    made[back] = strings(*tokenizer.decode(ids, borders))
                yield with_columns(batch, keep, row, len(part), made)

    shape = [*fields_of(docs, keep), "n_tokens bigint", "ids binary", *([f"`{back}` string"] if back else [])]
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(encode, ", ".join(shape))


def decoded(rows: DataFrame, path: str, keep=("doc_id", "n_tokens", "ids"), ids: str = "ids") -> DataFrame:
    """The columns `keep` and the text of each row's ids, special tokens included; null ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD, as in the library.
    """
    keep = list(keep)

    def decode(batches):
        tokenizer = byte_pairs(path)
        for batch in batches:
            values = pc.fill_null(batch.column("_ids").cast(pa.large_binary()), b"")
            for row, part in W.pieces(values, BLOCK):
                flat, borders = flat_binaries(part)
                if (borders % IDS.itemsize).any():
                    raise ValueError("ids are no 32-bit integers")
                data, at = tokenizer.decode(np.frombuffer(flat.tobytes(), IDS), borders // IDS.itemsize)
                yield with_columns(batch, keep, row, len(part), {"text": strings(data, at)})

    shape = ", ".join([*fields_of(rows, keep), "text string"])
    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(decode, shape)


def strings(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    texts = binaries(data, borders)
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the documents encoded, and decoded from their ids."""
    return encoded(docs, path, back="text").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
