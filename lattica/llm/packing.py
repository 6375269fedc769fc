"""Best-fit packing of token pieces into fixed-length sequences.

Documents are tokenized, ended by an id, and cut into pieces only if they are longer than a sequence. Pieces are dealt
by hash to groups of about GROUP_BINS sequences' tokens; each group is packed on its own, by best-two-fit: a sequence
takes the longest piece left, then again and again the longest that fits; then its smallest piece is replaced by two
unpacked ones that fill the widened gap more tightly, if there are such. A group wastes part of one sequence or so, out of
thousands, and the number of groups grows with the corpus.

Defined results: a null text is an empty one (the end id alone); repeated rows are packed once each; an empty table gives
no sequences.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import _IS_SPACE, slices

CAPACITY, END_ID = 4096, 1
#: Sequences that a group makes, about.
GROUP_BINS = 8192
#: Words and word ends whose ids a task remembers.
CACHE_WORDS = 1_000_000
#: ASCII punctuation, but for what begins a special token.
PUNCTUATION = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: A special token between words that are encoded as one text; and how many are.
MARK, RUN_WORDS = b"<|endoftext|>", 256
#: Bytes of text tokenized at once.
TEXT_BYTES = 2_000_000

_BYTES = [bytes([b]) for b in range(256)]
_IS_TAIL, _IS_ALNUM, _IS_UPPER = (np.array(x) for x in ([b in PUNCTUATION for b in _BYTES], [b.isalnum() for b in _BYTES], [b.isupper() for b in _BYTES]))
#: What keeps a word as it is written: bytes of other scripts; and that it may hold a special token.
_FOREIGN, _SPECIAL = 1, 2
_ODD = np.array([_FOREIGN * (b > 127) + _SPECIAL * (b == ord("<")) for b in range(256)], np.uint8)


def _units(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words of all texts in a row, with ends of punctuation apart; and where each text's begin and the last ends.

    An end is ASCII punctuation after an ASCII letter or digit. ASCII words are in lower case. Words with a "<", which may
    begin a special token, that is found as it is written, stay whole and as they are.
    """
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[offsets < len(data)]
    begins[heads] = word[heads]
    data, own = data[word], np.searchsorted(np.flatnonzero(begins), offsets)
    start = np.flatnonzero(begins[word])
    end = np.append(start[1:], len(data))
    if not len(start):
        return pa.array([], pa.binary()), own
    odd = np.bitwise_or.reduceat(_ODD[data], start)
    tail = _IS_TAIL[data]
    ended = np.flatnonzero(tail[end - 1] & (odd & _SPECIAL == 0))
    rest = np.concatenate([[-1], np.flatnonzero(~tail)])
    last = rest[np.searchsorted(rest, end[ended]) - 1]
    last = last[(last >= start[ended]) & _IS_ALNUM[data[last]]]
    upper = np.flatnonzero(_IS_UPPER[data])
    data[upper[odd[np.searchsorted(start, upper, "right") - 1] == 0]] += 32
    first = np.zeros(len(data) + 1, bool)
    first[start] = first[last + 1] = first[-1] = True
    cuts = np.flatnonzero(first)
    units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    return units, np.searchsorted(cuts, np.append(start, len(data))[own])


class WordCache:
    """Ids of white-space separated words, each encoded once while it is remembered.

    The vocabularies meant here drop white space before they merge, so that a text's ids are its words' ids in a row, and
    those of a word's parts as `_units` makes them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # where the mark is a special token, it is found before anything else, and words between two of them are as if alone
        known = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.mark = known.get(MARK.decode()) if all("<" in x for x in known) else None
        # where words' last tokens have a suffix, words of letters need no mark between them; a token has as many characters
        # as its text has bytes
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        many = max(vocabulary.values(), default=0) + 1
        self.suffixed, self.width = np.zeros(many, bool), np.zeros(many, np.int64)
        for token, i in vocabulary.items():
            self.suffixed[i] = token.endswith(suffix)
            self.width[i] = len(token.removesuffix(suffix))
        self._forget()

    def _forget(self) -> None:
        """place: number of each unit; unit i's ids are flat[start[i] : start[i] + size[i]]."""
        self.place: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and how many each text has."""
        units, cuts = _units(texts)
        coded = units.dictionary_encode()
        own, codes = _byte_strings(coded.dictionary), coded.indices.to_numpy()
        if len(self.place) > CACHE_WORDS:
            self._forget()
        at = np.fromiter(map(self.place.get, own, repeat(-1)), np.int64, len(own))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [own[i] for i in unknown.tolist()]
            self._learn(new)
            at[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        n = self.size[at][codes]
        ends = np.cumsum(n)
        place = np.repeat(self.start[at][codes] - (ends - n), n) + np.arange(n.sum())
        return self.flat[place], np.diff(np.concatenate([[0], ends])[cuts])

    def _learn(self, new: list[bytes]) -> None:
        words, flat, sizes = [], [], []

        def add(run: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
            words.extend(run)
            flat.append(ids)
            sizes.append(size)

        plain, rest, letters = [], [], self.suffixed.any()
        for x in new:
            (plain if letters and (x.isalpha() or not x.isascii() and x.decode().isalpha()) else rest).append(x)
        for run, ids in self._encoded(_runs(plain), b" "):
            cut = np.flatnonzero(self.suffixed[ids]) + 1
            size = np.diff(cut, prepend=0)
            # else a word isn't one to the tokenizer, or has become longer or shorter
            if len(cut) == len(run) and cut[-1] == len(ids) and np.add.reduceat(self.width[ids], cut - size).tolist() == list(map(len, run)):
                add(run, ids, size)
            else:
                rest.extend(run)
        # what has a "<" may hold a special token, and is encoded alone
        for run, ids in self._encoded([[x] for x in rest if b"<" in x or self.mark is None], b""):
            add(run, ids, np.array([len(ids)]))
        for run, ids in self._encoded(_runs([x for x in rest if b"<" not in x]) if self.mark is not None else [], MARK):
            cut = np.append(np.flatnonzero(ids == self.mark), len(ids))
            size = np.diff(cut, prepend=-1) - 1
            if len(cut) != len(run):
                raise ValueError(f"{len(run)} words between marks were encoded as {len(cut)}")
            add(run, ids[ids != self.mark], size)
        size = np.concatenate(sizes)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *flat])

    def _encoded(self, runs: list[list[bytes]], between: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
        texts = [between.join(run).decode() for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            yield run, np.array(e.ids, "<u4")


def _runs(words: list[bytes]) -> list[list[bytes]]:
    return [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]


def _byte_strings(values: pa.Array) -> list[bytes]:
    """`to_pylist` of a binary array without nulls, several times as fast."""
    data = values.buffers()[2].to_pybytes() if len(values) and values.buffers()[2] else b""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    return [data[a:b] for a, b in zip(at, at[1:])]


@cache
def _word_cache(path: str) -> WordCache:
    """One for each Python worker, which runs many tasks."""
    return WordCache(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): little-endian unsigned 32-bit ids of each piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_cache(tokenizer)
        for batch in slices(batches, most=TEXT_BYTES):
            of, piece, start, ids = [], [], [], []
            flat, sizes = words.ids([t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()])
            raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
            for i, (a, b) in enumerate(zip([0, *ends], ends)):
                x = raw[a:b] + END_ID.to_bytes(4, "little")
                for p, at in enumerate(range(0, len(x), 4 * capacity)):
                    of.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    ids.append(x[at : at + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return rows.mapInArrow(run, rows.schema[0].simpleString().replace(":", " ", 1) + ", piece int, start long, length long, ids binary")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; every length is between 1 and the capacity."""
    pools: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable").tolist():
        pools.setdefault(int(lengths[i]), []).append(i)
    have = 0  # bit n is set while a piece of length n is unpacked
    for n in pools:
        have |= 1 << n

    def longest(room: int) -> int:
        return (have & ((2 << room) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal have
        i = pools[n].pop()
        if not pools[n]:
            have &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal have
        pools[n].append(i)
        have |= 1 << n

    bins, offsets, number = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while have:
        row: list[int] = []
        room = capacity
        while room > 0 and (n := longest(room)) > 0:
            row.append(take(n))
            room -= n
        while room > 0 and have and len(row) > 1:
            small = int(lengths[row[-1]])  # the pieces of a row get shorter and shorter
            pair = _best_pair(have, pools, room + small)
            if pair is None or sum(pair) <= small:
                break
            gone, at = row.pop(), room + small
            for n in sorted(pair, reverse=True):
                row.append(take(n))
                at -= n
            give(small, gone)
            row.sort(key=lambda i: -lengths[i])
            room = at
        at = 0
        for i in row:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def _best_pair(have: int, pools: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """Two lengths on hand that fill `room` most tightly; the first exact fit from the longest down."""
    best = None
    a = (have & ((1 << room) - 1)).bit_length() - 1
    while a > 0 and 2 * a >= (sum(best) if best else 0):
        b = (have & ((2 << min(a, room - a)) - 1)).bit_length() - 1
        if b == a and len(pools[a]) < 2:
            b = (have & ((1 << a) - 1)).bit_length() - 1
        if b > 0 and (best is None or a + b > sum(best)):
            best = (a, b)
            if a + b == room:
                break
        a = (have & ((1 << a) - 1)).bit_length() - 1
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, start, length and more) with sequence_id and offset; read twice, so pass a written table."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * GROUP_BINS)))
    (group,) = ["_group"] if "_group" not in pieces.columns else ["_pack_group"]
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        first = table.column(group)[0].as_py() << 32
        table = table.drop_columns([group])
        return table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(group).applyInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces that still carry their ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    # binary concat by way of hex keeps it in the JVM
    return rows.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `docs`."""
    pieces = token_pieces(docs, tokenizer or tokenizer_path(), capacity)
    return pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity)


def packing_report(docs: DataFrame) -> DataFrame:
    return packed_pieces(docs)
