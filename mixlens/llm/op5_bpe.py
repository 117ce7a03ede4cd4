"""BPE encoding and decoding by a bounded-lookahead streaming transducer (see ``mixlens.llm.bpe``).

Both directions are narrow maps: no shuffle, a worker holds windows of bounded size beside its memo and its outputs, and a
lost executor costs only its own tasks.  ``digest`` holds no text's ids or decoded text whole.  Null texts count as empty and give no ids and the empty text; null keys are kept; repeated
rows give a row each; columns besides the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common
from mixlens.llm.bpe import Decoder, worker_transducer


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes, for the executors; its size is checked."""
    return common.bounded_broadcast(spark, common.file_bytes(path))


def encode(df: DataFrame, vocab: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, packed as little-endian unsigned 32-bit integers."""

    def run(batches):
        machine = worker_transducer(vocab.value)
        for keys, texts in common.text_batches(batches):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(machine.encode_many(texts), pa.binary())], ["doc_id", "ids"])

    return common.text_rows(df, key, text).mapInArrow(run, common.schema(doc_id=common.LONG, ids=T.BinaryType()))


def decode(df: DataFrame, vocab: Broadcast, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of packed ids; what isn't UTF-8 becomes U+FFFD, an unknown id nothing."""

    def run(batches):
        bpe = worker_transducer(vocab.value).bpe
        for batch in batches:
            keys = batch.column(0)
            texts = []
            for packed in batch.column(1):
                machine, packed = Decoder(bpe), packed.as_py() or b""
                texts.append("".join(machine.feed(packed[at : at + (1 << 18)]) for at in range(0, len(packed), 1 << 18)) + machine.feed(b"", True))
            yield pa.record_batch([keys, pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, common.schema(doc_id=common.LONG, text=common.STR))


def round_trip(df: DataFrame, vocab: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: both directions in one pass, the decoder fed with each block as the encoder emits it."""

    def run(batches):
        machine = worker_transducer(vocab.value)
        for keys, texts in common.text_batches(batches):
            ids, out, decoders = [[] for _ in texts], [[] for _ in texts], [Decoder(machine.bpe) for _ in texts]
            for k, packed in machine.run(texts):
                ids[k].append(packed)
                out[k].append(decoders[k].feed(packed))
            whole = ["".join(x) + d.feed(b"", True) for x, d in zip(out, decoders, strict=True)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(map(b"".join, ids), pa.binary()), pa.array(whole, pa.string())], ["doc_id", "ids", "decoded"])

    return common.text_rows(df, key, text).mapInArrow(run, common.schema(doc_id=common.LONG, ids=T.BinaryType(), decoded=common.STR))


def digest(df: DataFrame, vocab: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the same round trip, made block by block as the encoder emits."""

    def run(batches):
        machine = worker_transducer(vocab.value)
        for keys, texts in common.text_batches(batches):
            count, decoders = [0] * len(texts), [Decoder(machine.bpe) for _ in texts]
            ids, back = ([hashlib.sha256() for _ in texts] for _ in range(2))
            for k, packed in machine.run(texts):
                count[k] += len(packed) // 4
                ids[k].update(packed)
                back[k].update(decoders[k].feed(packed).encode())
            for h, d in zip(back, decoders, strict=True):
                h.update(d.feed(b"", True).encode())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(count, pa.int64()), *(pa.array([h.hexdigest() for h in x]) for x in (ids, back))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.text_rows(df, key, text).mapInArrow(run, common.schema(doc_id=common.LONG, n_tokens=common.LONG, ids_sha256=common.STR, decoded_sha256=common.STR))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    vocab = vocabulary(spark, common.tokenizer_path("byte_bpe_50k.json"))
    return digest(common.table(spark, sf_dir, "documents"), vocab)
