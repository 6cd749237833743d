"""Byte-level BPE by traversal of a trie of distinct pieces."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import lean
from ._pretokens import PieceTable


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Merges of a vocabulary file, applied to many pieces at once.

    Every prefix of a piece has a state, the last token of its encoding; what comes before that token is the encoding of a
    shorter prefix. A token may follow a state if encoding the two together leaves them apart, and exactly one of the
    tokens that end at a place may. Pieces are visited in sorted order, a depth-first walk of their trie, so the states of
    a shared prefix are found once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = model["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        # Ranks: single bytes first, then merged tokens in the order of their merges.
        self.tokens = [bytes([b]) for b in range(256)] + [raw(a + b) for a, b in merges]
        self.rank = {t: r for r, t in enumerate(self.tokens)}
        if len(self.rank) != len(self.tokens):
            raise ValueError("two merges make the same token")
        by_letters = {raw(t): i for t, i in vocabulary.items() if set(t) <= letters.keys()}
        self.codes = [by_letters[t].to_bytes(4, "little") for t in self.tokens]
        self.halves = [(b, b) for b in range(256)] + [(self.rank[raw(a)], self.rank[raw(b)]) for a, b in merges]
        self.merged = {h: 256 + i for i, h in enumerate(self.halves[256:])}
        self.longest = max(map(len, self.tokens))
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.text_of = {by_letters[t]: t for t in self.tokens} | {t["id"]: t["content"].encode() for t in model["added_tokens"]}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of left + right is these two tokens.

        Undoes merges from the latest back: if at any point the two tokens at the seam would have merged before
        the merge undone last, the seam does not hold.
        """
        limit = len(self.tokens)
        a, b = left, right
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and a >= 256:
                limit, a = a, self.halves[a][1]
            elif b >= 256:
                limit, b = b + 1, self.halves[b][0]
            elif a >= 256:
                limit, a = a, self.halves[a][1]
            else:
                return True

    def encode(self, pieces: list[str]) -> list[bytes]:
        found: dict[bytes, bytes] = {}
        raw = [p.encode() for p in pieces]
        state: list[int] = [-1]
        last = b""
        rank, tokens, apart = self.rank, self.tokens, self.apart
        for piece in sorted(set(raw)):
            shared = 0
            top = min(len(last), len(piece))
            while shared < top and last[shared] == piece[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                for begin in range(max(0, end - self.longest), end):
                    token = rank.get(piece[begin:end])
                    if token is None:
                        continue
                    before = state[begin]
                    if before < 0:
                        if begin == 0 and self._whole(token):
                            break
                        continue
                    fits = apart.get(before << 32 | token)
                    if fits is None:
                        if len(apart) > 300_000:
                            apart.clear()
                        fits = apart[before << 32 | token] = self.stays_apart(before, token)
                    if fits:
                        break
                state.append(token)
            out, end = [], len(piece)
            while end:
                token = state[end]
                out.append(self.codes[token])
                end -= len(tokens[token])
            out.reverse()
            found[piece] = b"".join(out)
            last = piece
        return [found[r] for r in raw]

    def _whole(self, token: int) -> bool:
        """Whether the encoding of the token's own bytes is the token, found once by plain merging."""
        known = self.whole.get(token)
        if known is None:
            parts = list(self.tokens[token])
            while len(parts) > 1:
                made, at = min((self.merged.get(pair, len(self.tokens)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if made == len(self.tokens):
                    break
                parts[at : at + 2] = [made]
            known = self.whole[token] = parts == [token]
        return known

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[TrieEncoder, PieceTable]:
    encoder = TrieEncoder(path)
    return encoder, PieceTable(path, encoder.encode)


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _loaded(path)
        try:
            for batch in batches:
                for i, codes in table.encoded(batch.column("text")):
                    n, ids_hash, text_hash, kept = [], [], [], []
                    for code in codes:
                        ids = np.frombuffer(code, "<u4")
                        n.append(len(ids))
                        ids_hash.append(hashlib.sha256(code).hexdigest())
                        text_hash.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                        if with_ids:
                            kept.append(ids.view(np.int32))
                    columns = {"doc_id": batch.column("doc_id").slice(i, len(codes)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
                    if with_ids:
                        columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        finally:
            _loaded.cache_clear()  # some 200 MB, which an idle worker would keep from the steps that follow

    return run


def encode_documents(docs: DataFrame, tokenizer: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for every row of ``docs(doc_id, text)``.

    ``tokenizer`` is the path of a byte-level BPE file. Ids are those of its library without special tokens added; a
    special token's own string in a text becomes that token, as there. Decoding takes the ids alone. Null is the empty
    text, with no ids. Rows are independent: repeated rows, null doc_ids and other columns make no difference.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_digests(tokenizer, with_ids)), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
