"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (dummy prefix, spaces escaped) and cut where no piece can cross. The distinct
words of a batch lie in one flat numpy array of symbols. Each round finds the smallest pair rank of every word, merges
all its leftmost non-overlapping occurrences at once and compacts the array, until no word has a pair left.

Edge cases: a null or empty text has the end id only; characters outside the vocabulary become byte pieces; a text of
any length is encoded whole; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, read_documents, released

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
#: Words of more symbols are merged one pair at a time from a heap: rounds over one long word would be quadratic.
LONG_WORD = 256
#: Words kept encoded between batches of a Python worker; beyond it the memory is emptied.
CACHE_WORDS = 150_000


#: U+FFFD for every byte that is part of no character.
codecs.register_error("one_mark_a_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceCodec:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model file."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("this codec reads BPE models with byte fallback and the identity normaliser")
        self.prefix = norm.add_dummy_prefix
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
            self.surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" if p.type == 3 else " ⁇ ".encode())
        self.eos = next(i for i, p in enumerate(model.pieces) if p.type == 3 and p.piece == "</s>")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        order = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.n = len(model.pieces)
        pairs = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (order[model.pieces[i].score], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, NO_RANK)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NO_RANK], dtype=np.int64)
        self.to = np.array([pairs[k][1] for k in keys.tolist()] + [-1], dtype=np.int64)
        self.pairs = pairs
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.id_of.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.spaced = {i for c, i in self.id_of.items() if c[0] == SPACE}
        self.cache: dict[str, tuple[str, str]] = {}

    # -- encoding

    def pair_slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into rank and to; the last one says that the pair makes no piece."""
        key = np.where((a < 0) | (b < 0), -1, a * self.n + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (already escaped). Symbols below 0 stand for characters outside the vocabulary."""
        out: list[list[int]] = [[] for _ in words]
        rows = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.spell(self.merge_by_heap([self.id_of.get(c, -1 - ord(c)) for c in w]))
            else:
                rows.append(i)
        chars = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.of_char[chars].astype(np.int64)
        word = np.repeat(np.arange(len(rows)), np.fromiter((len(words[i]) for i in rows), np.int64, len(rows)))
        slot = self.pairs_of(sym, word)
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            rank = self.rank[slot]
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(sym)])
            best = np.repeat(least, size)
            if (least == NO_RANK).any():  # compaction: words without a pair leave
                live = best != NO_RANK
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, slot, rank, best = sym[live], word[live], slot[live], rank[live], best[live]
                if not len(sym):
                    break
            # leftmost non-overlapping: every other one within a run of hits that touch
            idx = np.flatnonzero(rank == best)
            of = word[idx]
            fresh = np.r_[True, (np.diff(idx) > 1) | (of[1:] != of[:-1])]
            if not fresh.all():
                first = np.flatnonzero(fresh)
                idx = idx[(np.arange(len(idx)) - first[np.cumsum(fresh) - 1]) % 2 == 0]
                of = word[idx]
            idx = self.in_turn(sym, word, slot, best, idx, np.r_[True, of[1:] != of[:-1]])
            sym[idx] = self.to[slot[idx]]
            keep = np.ones(len(sym), dtype=bool)
            keep[idx + 1] = False
            sym, word, slot = sym[keep], word[keep], slot[keep]
            idx = idx - np.arange(len(idx))  # where the merged ones are now; only their pairs and their left neighbours' change
            touched = np.unique(np.r_[idx, idx[idx > 0] - 1])
            nxt = np.minimum(touched + 1, len(sym) - 1)
            slot[touched] = np.where((touched + 1 < len(sym)) & (word[touched] == word[nxt]), self.pair_slot(sym[touched], sym[nxt]), len(self.keys) - 1)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        ends = np.searchsorted(word, np.arange(len(rows) + 1)).tolist()
        listed, lone = sym.tolist(), set(word[sym < 0].tolist())
        for k, i in enumerate(rows):
            ids = listed[ends[k] : ends[k + 1]]
            out[i] = self.spell(ids) if k in lone else ids
        return out

    def pairs_of(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Slot of the pair that each symbol makes with the next one of its word."""
        slot = np.full(len(sym), len(self.keys) - 1)
        inside = np.flatnonzero(word[1:] == word[:-1])
        slot[inside] = self.pair_slot(sym[inside], sym[inside + 1])
        return slot

    def in_turn(self, sym, word, slot, best, idx, leader):
        """Of simultaneous merges, those that one-at-a-time merging would make as well before any other: where a merge
        makes a pair that ranks no worse than the merged one, only the word's first merge is made in this round."""
        if leader.all():
            return idx
        several = ~leader
        several[:-1] |= ~leader[1:]
        at = idx[several]
        made, n = self.to[slot[at]], len(sym)
        after = sym.copy()
        after[idx] = after[idx + 1] = self.to[slot[idx]]  # what a left neighbour is once merged
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        has_left, has_right = (at > 0) & (word[left] == word[at]), (at + 2 < n) & (word[right] == word[at])
        new = np.where(has_left, self.rank[self.pair_slot(after[left], made)], NO_RANK)
        new = np.minimum(new, np.where(has_right, self.rank[self.pair_slot(made, sym[right])], NO_RANK))
        new = np.minimum(new, np.where(has_left, self.rank[self.pair_slot(sym[left], made)], NO_RANK))
        odd = np.unique(word[at[new <= best[at]]])
        return idx[leader | ~np.isin(word[idx], odd)]

    def merge_by_heap(self, sym: list[int]) -> list[int]:
        """One merge at a time: best rank first, then leftmost."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] * self.n + sym[j])):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if not gone[i] else -1
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], right[i] = self.pairs[a * self.n + b][1], True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def spell(self, symbols: list[int]) -> list[int]:
        """Byte pieces in place of characters outside the vocabulary."""
        out: list[int] = []
        for s in symbols:
            out.extend([s] if s >= 0 else self.byte_id[list(chr(-1 - s).encode())].tolist())
        return out

    def words(self, text: str) -> list[str]:
        return self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(self.words(text)) for i in ids]

    # -- decoding

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Whole text of ids; control ids vanish, the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], False
        for i in ids:  # byte pieces join up before they are read as UTF-8
            byte = len(self.surface[i]) == 1 and i == self.byte_id[self.surface[i][0]]
            if byte and raw:
                out[-1] += self.surface[i]
            else:
                out.append(self.surface[i])
            raw = byte
        text = "".join(b.decode("utf-8", "one_mark_a_byte") for b in out)
        return text[1:] if self.prefix and next((i for i in ids if self.surface[i]), -1) in self.spaced else text

    # -- documents

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids with the end id, their digest, digest of the decoded text) of each text."""
        cut = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        fresh = [w for w in set().union(*cut) if w not in cache] if cut else []
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                cache[w] = (" ".join(map(str, ids)), self.decode_bytes(ids).decode("utf-8", "one_mark_a_byte"))
        out = []
        for ws in cut:
            found = [cache[w] for w in ws]
            ids = " ".join([*[x[0] for x in found], str(self.eos)])
            text = "".join([x[1] for x in found])
            if self.prefix and text:
                text = text[1:]
            out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec per Python worker and model."""
    return PieceCodec(model_file)


def slices(texts: list[str], limit: int = 1_000_000):
    """Runs of texts of about ``limit`` characters, so that memory is bounded by that and the longest text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield encoded(batch)
        codec(model_file).cache.clear()  # the worker may go on to other stages

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for part in slices(batch.column(1).to_pylist()) for r in codec(model_file).encode_texts(part)]
        return pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
