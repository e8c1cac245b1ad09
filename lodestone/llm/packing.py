"""Packing of token sequences by power-of-two decomposition.

A document of n ids is cut into pieces of the largest length and then, for what remains, into one piece for each binary
digit of the remainder, longest first. A piece is a sequence of its own whose length is a power of two, so it needs no
padding and never crosses documents. write_buckets() puts sequences of one length in a folder of their own, and a trainer draws batches from a folder. Since a document's pieces depend on
nothing else, there is no shuffle and no state, at any size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table

LENGTH, END = 4096, 2


def pieces(n: int, longest: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids."""
    out = [(k, longest) for k in range(0, n - longest + 1, longest)]
    start, bit = len(out) * longest, longest >> 1
    while start < n:
        if (n - start) & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


#: How the public word tokenizer splits a text (the vocabulary's own pattern) and marks the end of a word.
_SPLIT, _SUFFIX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: What that pattern finds besides runs of letters, for characters of the Latin blocks; and any text with other characters.
_OTHER = re.compile(r"('(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+|[0-9²³¹¼-¾])")
_BEYOND = re.compile(r"[^\t\n\x0b\x0c\r -~\xa1-\u012f\u0131-\u024f]|<\|")
_SPACES = "\t\n\x0b\x0c\r"


class Encoder:
    """Ids of whole texts by a tokenizers file.

    The library takes about a second a megabyte. A vocabulary of words with end marks can be read by a faster merger of bytes: in
    place of the mark, which white space can't be part of, stands a blank, so that a piece is a word and the blank after it, and
    the ids are the ranks. Texts beyond the Latin blocks, and vocabularies of another kind, go through the library.
    """

    def __init__(self, path: str):
        self.path, self.library, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") == _SUFFIX and _SPLIT in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            import tiktoken

            special, byte = {t["content"] for t in spec["added_tokens"]}, _bytes_of_symbols()
            ranks = {bytes(byte[c] for c in t.removesuffix(_SUFFIX)) + b" " * t.endswith(_SUFFIX): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        """The library's tokenizer, read when a text first needs it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        text = text.lower()
        for c in _SPACES:
            text = text.replace(c, " ")
        return self.fast.encode_to_numpy(" ".join(_OTHER.split(text)) + " ")


def _bytes_of_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary: itself if printable, otherwise the next from 256 on."""
    # The bytes that such vocabularies take for printable.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LENGTH, end: int = END) -> DataFrame:
    """Tokenize documents and pack them into sequences of at most longest ids, a power of two.

    docs: doc_id (integer) and text; other columns are left out. tokenizer is the path of a tokenizers file, there on every
    executor; by default the public one with 49k words. A text's ids end with the id end; a null or empty text is
    that id alone. Returns a row for each piece: doc_id, start, length, ids (array), doc_tokens, sequence_id, offset
    (always 0: a piece fills its sequence). A row given twice is packed twice. An empty table gives an empty table. The
    sequence ids come from the partition and the place in it, so they are distinct, and a repeated task gives
    them again as long as the input is read in the same order.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest has to be a power of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                ids, start, length, total, data = [], [], [], [], []
                for doc, text in zip(batch["doc_id"][k : k + 128].to_pylist(), batch["text"][k : k + 128].to_pylist(), strict=True):
                    found = np.append(encoder.ids(text or ""), np.uint32(end))
                    for a, n in pieces(len(found), longest):
                        ids.append(doc)
                        start.append(a)
                        length.append(n)
                        total.append(len(found))
                    data.append(found)
                flat = np.concatenate(data).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), lists, pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    out = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, "doc_id long, start long, length long, ids array<int>, doc_tokens long")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences of pack() as Parquet with a folder for each length, so that a reader that takes batches from one folder has sequences of
    equal length. No shuffle: a task writes to as many folders as there are lengths, 13 for sequences of up to 4096."""
    packed.write.partitionBy("length").parquet(path)


def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each piece as an unsigned CRC-32 of little-endian 32-bit numbers."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        lists = batch.column(at)
        flat, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64())
        yield batch.set_column(at, "ids_crc32", crc)


DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).mapInArrow(checksum, DIGEST)
