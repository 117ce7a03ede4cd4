"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is run through its own merge list; those that come out as one token are proved to be
whole.  A pre-token among them counts one without any merging; only the rest is merged.  A narrow map: no shuffle.

Null texts count as empty (0 bytes, 0 tokens); null keys are kept; repeated rows give a row each; further columns are
ignored.  Strings of added tokens inside a text count one token each, as the library's default has it.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from mixlens.llm import common
from mixlens.llm.bpe import SHORT, ByteBPE, Engine, added_pattern, sections
from mixlens.llm.op5_bpe import vocabulary
from mixlens.llm.pretokens import SPACES, word_level_pattern

#: Chunks whose counts a worker keeps.
MEMO_ENTRIES = 600_000
#: Controls that str.split() takes for white space and the tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile(f"[{SPACES}]+")


class Counter:
    """Numbers of tokens under a word-level BPE: NFC, lower case, white space dropped, an end-of-word mark."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.engine = bpe, Engine(bpe)
        self.find, self.added = word_level_pattern().findall, added_pattern(bpe.added)
        self.whole = self.prove()
        self.memo: dict[str, int] = {}

    def prove(self) -> frozenset[bytes]:
        """The byte strings that encode alone as one token."""
        words = [self.bpe.bytes_of[i] for t, i in self.bpe.vocab.items() if t.endswith(self.bpe.end)]
        words = [w for w in words if 0 < len(w) <= SHORT]
        counts = self.engine(words)[1]
        return frozenset(w for w, n in zip(words, counts.tolist(), strict=True) if n == 1)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def learn(self, chunks: set[str]) -> None:
        """Counts of chunks without white space that the memo lacks."""
        found = {c: [c.encode()] if c.isalpha() else [t.encode() for t in self.find(c)] for c in chunks}
        rest = list(set().union(*found.values()) - self.whole)
        short = [w for w in rest if len(w) <= SHORT]
        of = dict(zip(short, self.engine(short)[1].tolist(), strict=True)) if short else {}
        of |= {w: sum(map(len, self.bpe.stream(w))) for w in rest if len(w) > SHORT}
        get = of.get
        self.memo.update((c, sum(get(t, 1) for t in tokens)) for c, tokens in found.items())

    def count_many(self, texts: list[str | None]) -> list[int]:
        special, chunks = [0] * len(texts), []
        for k, text in enumerate(texts):
            own = []
            text = text or ""
            for start, end, token in sections(text, self.added, self.bpe.added):
                section = self.normal(text[start:end])
                own += WHITE.split(section) if SEPARATORS.search(section) else section.split()
                special[k] += token is not None
            chunks.append(own)
        new = set().union(*chunks).difference(self.memo)
        full = len(self.memo) >= MEMO_ENTRIES
        self.learn(new)
        get = self.memo.__getitem__
        out = [n + sum(map(get, own)) for n, own in zip(special, chunks, strict=True)]
        if full:
            for c in new:
                del self.memo[c]
        return out


_loaded: dict[int, Counter] = {}


def worker_counter(raw: bytes) -> Counter:
    if hash(raw) not in _loaded:
        _loaded[hash(raw)] = Counter(ByteBPE.from_json(raw))
    return _loaded[hash(raw)]


def count(df: DataFrame, vocab: Broadcast, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text."""

    def run(batches):
        counter = worker_counter(vocab.value)
        for keys, texts in common.text_batches(batches):
            n = np.array(counter.count_many(texts), np.int64)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    fields = common.schema(doc_id=common.LONG, n_bytes=common.LONG, n_tokens=common.LONG, over_limit=common.BOOL)
    return common.text_rows(df, key, text).mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document under the word-level vocabulary."""
    vocab = vocabulary(spark, common.tokenizer_path("word_bpe_49k.json"))
    return count(common.table(spark, sf_dir, "documents"), vocab)
