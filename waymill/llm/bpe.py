"""BPE encoding and decoding by a distinct-word table.

A run of characters without white space always encodes alike, wherever it stands: the tokenizer's normalizer
and its splitting never join two such runs. So words are split once, each distinct word is encoded once in its
shard, and ids are joined back by position; decoding joins ids to their pieces.

Null text is empty and has no ids. Rows with equal ids or texts each get their own row. An empty table gives an
empty result. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common as C
from . import vocabulary as V

#: The splitting of the tokenizer file, for words of PLAIN characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters that are in normal form C, no white space, and whose lower case is one to one.
PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]*")


@cache
def _byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class WordEncoder:
    """ids of a word without white space, exactly as the tokenizer gives them for any text that holds it.

    Words and parts of words are kept in two generations of at most remember each: when the new one is full it
    becomes the old one, and what the old one had and was not asked for is forgotten, to be encoded again.
    """

    def __init__(self, path: str, remember: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.remember = self.tokenizer.model, remember
        self.words, self.old_words, self.parts, self.old_parts = {}, {}, {}, {}
        self.split = regex.compile(SPLIT).findall

    def part(self, part: str) -> bytes:
        """ids of one run of letters, one digit or one run of signs, in lower case."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                shown = part if part.isascii() else "".join([_byte_letters()[b] for b in part.encode()])
                ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.parts) >= self.remember:
                self.parts, self.old_parts = {}, self.parts
            self.parts[part] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        got = self.words.get(word)
        if got is None:
            got = self.old_words.get(word)
            if got is None:
                if word.isalpha():  # of bytes: A-Z and a-z only
                    got = self.part(word.decode().lower())
                else:
                    text = word.decode("utf-8", "replace")
                    if PLAIN.fullmatch(text) and "<|" not in text:
                        got = b"".join([self.part(p) for p in self.split(text.lower())])
                    else:
                        got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.words) >= self.remember:
                self.words, self.old_words = {}, self.words
            self.words[word] = got
        return got

    def text(self, text: bytes) -> bytes:
        """ids of a whole text."""
        known, encode = self.words.get, self.encode  # known may become the old generation on the way
        return b"".join([known(w) or encode(w) for w in text.split()])


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, until tasks of another operator follow."""
    return WordEncoder(path)


C.FORGETS.append(encoder.cache_clear)


@cache
def pieces(path: str) -> np.ndarray:
    """The piece of each id: as many entries as the vocabulary file has, whatever the corpus."""
    tokenizer = Tokenizer.from_file(path)
    return np.array([(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())], object)


ENCODED = "doc_id long, ids array<int>"
FINISHED = "block long, shard int, sizes binary, ids binary"
_FINISHED = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _shard_encoder(path: str):
    def answer(shard, lists):
        own = encoder(path)
        own.words, own.old_words, own.parts, own.old_parts = {}, {}, {}, {}
        own.remember = 1 << 62  # all distinct words of one shard
        for block, vocab, _ in lists:
            found = [own.encode(w) for w in C.unpack(vocab).split(b"\n")]
            sizes = np.fromiter((len(x) // 4 for x in found), np.uint32, len(found))
            ids = np.frombuffer(b"".join(found), "<u4")
            yield C.rows(_FINISHED, [(block, shard, C.pack(sizes), C.pack(ids.astype(np.uint16) if len(ids) and ids.max() < 65536 else ids) if len(ids) else b"")])

    return answer


def _word_table(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: word numbers by position, ids of all words, where each word's ids start, how many they are."""
    found = sorted(zip(*(right.column(c).to_pylist() for c in ("shard", "sizes", "ids")), strict=True))
    sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for _, s, i in found:
        sizes.append(C.unpack(s, np.uint32))
        raw = C.unpack(i)
        wide = len(raw) == 4 * int(sizes[-1].sum())
        ids.append(np.frombuffer(raw, np.uint32 if wide else np.uint16).astype(np.uint32))
    counts = np.concatenate(sizes).astype(np.int64)
    return C.unpack(left.column("words")[0].as_py(), np.int32), np.concatenate(ids), C.starts(counts)[:-1], counts


def _finish(docs: DataFrame, path: str, finish, schema: str, id_col: str, text: str) -> DataFrame:
    """finish(id, its word numbers, its ids, word table) for every document, block by block."""
    rows = C.whole(docs, id_col, text)
    n = C.shards_for(docs.sparkSession, C.text_bytes(rows))
    table = V.blocks(rows, n)
    back = V.answers(table, _shard_encoder(path), FINISHED)
    arrow = pa.schema([pa.field(*x) for x in schema])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        words, ids, begin, sizes = _word_table(left, right)
        flat = ids[C.spans(begin[words], sizes[words])]
        counts = np.array(left.column("counts")[0].as_py(), np.int64)
        at, id_at = C.starts(counts), C.starts(sizes[words])
        make = finish(ids, begin, sizes)
        out = [(doc, *make(words[at[i] : at[i + 1]], flat[id_at[at[i]] : id_at[at[i + 1]]])) for i, doc in enumerate(left.column("ids")[0].as_py())]
        return pa.Table.from_batches([C.rows(arrow, out)], arrow)

    spark_schema = ", ".join(f"{n} {_SQL[str(t)]}" for n, t in schema)
    return table.select("block", "ids", "counts", "words").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(block, spark_schema)


_SQL = {"int64": "long", "string": "string", "list<item: int32>": "array<int>"}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, without special tokens."""

    def finish(*_):
        return lambda words, ids: (ids.astype(np.int32),)

    return _finish(docs, path, finish, [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))], id_col, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the pieces of the ids, joined as the tokenizer joins them (by one blank).

    The id-to-piece table has one row for each id of the vocabulary file, so it goes to every task. Null or no
    ids give an empty text; an id that the file lacks gives nothing.
    """

    @F.pandas_udf("string")
    def decoded(column):
        table = pieces(path)
        return column.map(lambda x: b" ".join([p for i in (x if x is not None else ()) if 0 <= i < len(table) and (p := table[i])]).decode("utf-8", "replace"))

    return encoded.withColumn("decoded", decoded(F.col(ids)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""

    def finish(ids, begin, sizes):
        joined, table = [], pieces(path)[ids]  # the id-to-piece join, once for each distinct word
        for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            joined.append(b" ".join(table[b : b + n].tolist()))
        bare = not sizes.all()  # a word may have no ids; then it adds no blank either

        def make(words, own):
            found = [joined[w] for w in words.tolist()]
            text = b" ".join([x for x in found if x] if bare else found)
            return len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

        return make

    return _finish(docs, path, finish, [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], id_col, text)


