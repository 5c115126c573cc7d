"""Token ids as Arrow files of equal-length sequences.

Documents in ascending id are encoded, each closed by an end id, and cut into sequences of
``LENGTH`` ids. A task writes one stream of batches into an Arrow IPC file: fixed-size lists
of ids (the smallest unsigned type that holds the vocabulary) and of mask bits (0: padding,
in a file's last sequence only). The file's last sequence is padded, the next file goes on
with the next document. Fixed-size lists are one flat buffer a batch, so a reader maps the
file and takes any sequence or any document as a view, without copying. A second small Arrow
file beside it has each document's first place and number of ids.

Files carry fresh names and are listed in a written manifest, so those of lost attempts are
never read. Places over all files come from the manifest's running sum (a row a file).

Defined cases: null is an empty text (its end id only); rows without id come first; rows of
one id are ordered by text; an empty table writes no files; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.llm.stages import fresh_path, written
from turnledger.llm.warc import open_folder

LENGTH, BATCH_SEQUENCES = 2048, 256
END_ID = 2
CACHE_WORDS = 400_000

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """Encodes whole texts with a word-level vocabulary file of the tokenizers library; as a
    dictionary it holds the ids (bytes of ``kind``) of the words seen, and learns new ones.

    The tokenizer drops white space and splits at it, so a text's ids are those of its words
    one after the other; each different word is given to the library once while the cache
    lasts. The cache has two generations of ``CACHE_WORDS``; words met again move to the new
    one. Texts that may hold a special token ("<|") are given to it whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.id_bytes = [np.array([i], self.kind).tobytes() for i in range(self.size)]
        self.old: dict[bytes, bytes] = {}
        # What the library makes of each Latin letter (none of them combine) on the way to its model.
        self.letters: dict[int, str] = {}
        for c in range(65, 0x180):
            plain = self.tokenizer.normalizer.normalize_str(chr(c))
            if chr(c).isalpha() and plain.isalpha():
                self.letters[c] = self.bytes_of.pre_tokenize_str(plain)[0][0]
        self.latin = re.compile(f"[{''.join(map(chr, self.letters))}]+").fullmatch

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _ids(self, part: str) -> bytes:
        if not self.latin(part):
            if not part.isalpha():
                return self._library(part)
            plain = self.tokenizer.normalizer.normalize_str(part)
            if not plain.isalpha():
                return self._library(part)
            letters = self.bytes_of.pre_tokenize_str(plain)[0][0]
        else:
            letters = part.translate(self.letters)
        # A run of letters is one piece of the pre-tokenizer, given to the model by itself.
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            # A run of letters and the punctuation after it are split by the tokenizer anyway.
            core = word.rstrip(b".,;:!?")
            if len(core) < len(word) and core.decode().isalpha():
                found = self[core] + self[word[len(core) :]]
            else:
                found = self._ids(word.decode())
        self[word] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as bytes of ``kind``."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return [
            self._library(text.decode()) if b"<|" in text else b"".join(map(self.__getitem__, text.lower().split()))
            for text in texts
        ]


def _schema(kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "order_key bigint, part int, file string, documents bigint, tokens bigint"


def _batch(ids: np.ndarray, real: int, kind) -> pa.RecordBatch:
    mask = np.zeros(len(ids), bool)
    mask[:real] = True
    lists = [
        pa.FixedSizeListArray.from_arrays(pa.array(ids), LENGTH),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH),
    ]
    return pa.RecordBatch.from_arrays(lists, schema=_schema(kind))


def _file_writer(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder.of(vocabulary)
        system, path = open_folder(folder)
        name = f"tokens-{uuid.uuid4().hex}"
        sink = sequences = docs_sink = docs = None
        rest, total, documents = np.zeros(0, encoder.kind), 0, 0
        step = LENGTH * BATCH_SEQUENCES
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            if sink is None:
                sink = system.open_output_stream(f"{path}/{name}.arrow", compression=None)
                sequences = ipc.new_file(sink, _schema(encoder.kind))
                docs_sink = system.open_output_stream(f"{path}/{name}.docs.arrow", compression=None)
                docs = ipc.new_file(docs_sink, _DOCS)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for low in range(0, len(texts), 500):
                found = encoder.encode(texts[low : low + 500])
                sizes = np.array([len(x) // encoder.kind.itemsize + 1 for x in found], np.int64)
                starts = total + np.cumsum(sizes) - sizes
                docs.write_batch(
                    pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(found)), pa.array(starts), pa.array(sizes)], schema=_DOCS)
                )
                total += int(sizes.sum())
                documents += len(found)
                rest = np.concatenate([rest, np.frombuffer(end.join(found) + end, encoder.kind)])
                while len(rest) >= step:
                    sequences.write_batch(_batch(rest[:step], step, encoder.kind))
                    rest = rest[step:]
        if sink is None:
            return
        if len(rest):
            padded = np.zeros(-(-len(rest) // LENGTH) * LENGTH, encoder.kind)
            padded[: len(rest)] = rest
            sequences.write_batch(_batch(padded, len(rest), encoder.kind))
        for x in (sequences, sink, docs, docs_sink):
            x.close()
        part = TaskContext.get().partitionId()
        row = (0, part, name, documents, total)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["order_key", "part", "file", "documents", "tokens"])

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of ``docs`` into ``folder``; returns the manifest: file, documents,
    tokens and ``before``, the ids of all files before it."""
    system, path = open_folder(folder)
    system.create_dir(path)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ranges end between ids or, where an id repeats, anywhere in its order by text.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = written(ordered.mapInArrow(_file_writer(folder, vocabulary, end_id), _MANIFEST), "token_files")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", "file", "documents", "tokens", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("before"))


class TokenFile:
    """Random access to one file: sequences, masks and documents as views of the mapped file."""

    def __init__(self, system: fs.FileSystem, path: str):
        local = isinstance(system, fs.LocalFileSystem)
        open_file = (lambda p: pa.memory_map(p)) if local else system.open_input_file
        self.reader = ipc.open_file(open_file(f"{path}.arrow"))
        self.docs = ipc.open_file(open_file(f"{path}.docs.arrow")).read_all()
        self.step = LENGTH * BATCH_SEQUENCES

    def _flat(self, batch: int, column: str):
        return self.reader.get_batch(batch).column(column).flatten()

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = divmod(n, BATCH_SEQUENCES)
        ids = self._flat(batch, "ids").to_numpy()[at * LENGTH : (at + 1) * LENGTH]
        mask = self._flat(batch, "mask").slice(at * LENGTH, LENGTH).to_numpy(zero_copy_only=False)
        return ids, mask

    def pieces(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``start`` on, one for each batch they lie in."""
        while size:
            batch, at = divmod(start, self.step)
            take = min(size, self.step - at)
            yield self._flat(batch, "ids").to_numpy()[at : at + take]
            start, size = start + take, size - take


def _file_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                file = TokenFile(system, f"{path}/{name}")
                crcs = []
                for start, size in zip(file.docs["start"].to_pylist(), file.docs["n_tokens"].to_pylist()):
                    crc = 0
                    for piece in file.pieces(start, size):
                        crc = zlib.crc32(piece.astype("<u4"), crc)
                    crcs.append(crc)
                table = file.docs.combine_chunks()
                columns = [table["doc_id"], pa.array(table["start"].to_numpy() + before), table["n_tokens"], pa.array(crcs, pa.int64())]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # A number of its own keeps files apart: a row is small, a file is not.
    files = manifest.select("file", "before").repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file"
    )
    return files.mapInArrow(_file_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_output(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    manifest = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, folder)
