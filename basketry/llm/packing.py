"""Packing by power-of-two decomposition.

The ids of a document (its text's, then one end id) are cut into as many
full pieces of ``max_len`` as fit and then into the powers of two of the
rest's binary form.  Every piece is a sequence of its own: no sequence
crosses documents and none is padded, as each length is a power of two.
Pieces of equal length share a bucket, so a batch taken from one bucket is
rectangular.

Rows are independent, so this is one pass without a shuffle.  Tokenising
goes word by word through a bounded cache per Python worker: the vocabulary's
pre-tokeniser never joins across ASCII white space, and a text's ids are the
joined ids of its words (tests compare with whole-text encoding).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import whole

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 1_200_000  # per Python worker; emptied when full
CACHED_BYTES = 64      # longer words are encoded each time
ROWS = 500             # documents per batch handed back to Spark
_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("bucket", pa.int32())])
_MARK = re.compile(rb"(?<=[A-Za-z0-9])[.,;:!?)](?!\S)")
_state: dict = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _encoder(path: str):
    if _state.get("path") != path:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _state.update(path=path, tokenizer=tokenizer, cache={}, ends=ends)
    return _state["tokenizer"], _state["cache"]


def _words(text: str) -> list[bytes]:
    """What to encode one by one: a text's words, ASCII in lower case, as the
    vocabulary's normaliser does, and one mark between an ASCII letter or
    digit and white space apart, as its pre-tokeniser does.  A text that may
    name special tokens keeps its case, and so does one with combining marks
    (U+0300 to U+037F), which the normaliser composes before it lowers."""
    raw = text.encode("utf-8", "replace")
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return _MARK.sub(rb" \g<0>", raw).split()


def _ids_of(words: list[bytes], tokenizer, ends: np.ndarray) -> Iterator[bytes]:
    """The ids of each word.  Runs of letters are one pre-token each, so a
    joined text of them is parted again at the tokens that end a word; where
    the number of ends is not that of the words, and for all other words,
    each is encoded by itself."""
    text = [w.decode("utf-8") for w in words]
    if len(words) > 1 and all(map(str.isalpha, text)):
        ids = np.array(tokenizer.encode_batch_fast([" ".join(text)], add_special_tokens=False)[0].ids, "<u4")
        stop = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        if len(stop) == len(words):
            raw = ids.tobytes()
            return (raw[lo:hi] for lo, hi in zip([0, *stop], stop))
    made = tokenizer.encode_batch_fast(text, add_special_tokens=False)
    return (np.array(e.ids, "<u4").tobytes() for e in made)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit values."""
    tokenizer, cache = _encoder(path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    split = [_words(t) for t in texts]
    new = set().union(*split).difference(cache)
    letters = {w for w in new if w.isalpha() or w.decode("utf-8").isalpha()}
    for some_kind in (list(letters), list(new - letters)):
        for at in range(0, len(some_kind), 512):
            some = some_kind[at:at + 512]
            cache.update(zip(some, _ids_of(some, tokenizer, _state["ends"])))
    out = [b"".join(map(cache.__getitem__, words)) for words in split]
    for w in [w for w in new if len(w) > CACHED_BYTES]:
        del cache[w]
    return out


def pieces(n: int, max_len: int) -> list[int]:
    """Lengths, longest first: full pieces, then the binary form of the rest."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, bucket (log2 of length), sequence_id, offset.

    ``max_len`` must be a power of two.  Null or empty text: the end id
    alone.  Null id: kept as null.  Repeated rows are packed each.  Empty
    table: no rows.  Other columns are not read.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                cols: dict[str, list] = {f.name: [] for f in _PIECES}
                for i, ids in zip(part.column("id").to_pylist(), encode(part.column("text").to_pylist(), path)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    cut = pieces(total, max_len)
                    for n in cut:
                        cols["start"].append(start)
                        cols["ids"].append(ids[4 * start:4 * (start + n)])
                        start += n
                    cols["length"] += cut
                    cols["id"] += [i] * len(cut)
                    cols["doc_tokens"] += [total] * len(cut)
                    cols["bucket"] += [n.bit_length() - 1 for n in cut]
                yield pa.RecordBatch.from_pydict(cols, schema=_PIECES)

    made = rows.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces by bucket, so that a reader gets equal lengths together."""
    packed.write.partitionBy("bucket").parquet(path)
