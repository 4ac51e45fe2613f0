"""SentencePiece encoding and decoding with vectorised merge rounds.

A batch's texts become flat numpy arrays. Texts fall apart wherever two neighbouring characters
stand together in no piece of the vocabulary, so no merge can cross the cut; equal parts are
encoded once. In each round every part merges all leftmost occurrences of its best pair at the
same time, and parts without a pair leave the arrays. A part whose simultaneous merges would
open an equal or better pair takes only its leftmost merge that round, so that the result is
that of the one-merge-at-a-time queue.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import slices

SPACE = "▁"
NO_PAIR = 2**31 - 1
#: Words whose ids a task keeps for its next batches; beyond it the task starts anew.
KNOWN_WORDS = 500_000
HASH = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


def _words(text: str) -> list[str]:
    """Cut at spaces: no piece has a space after another character. Further spaces stay before their word."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, extra = [], 0
    for word in words[:-1]:
        if word:
            out.append(" " * extra + word)
            extra = 0
        else:
            extra += 1
    out.append(" " * extra + words[-1])
    return out


class PieceModel:
    """A sentencepiece BPE vocabulary with byte fallback, identity normalisation and dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.get_piece_size()
        self.bos, self.eos, self.unk = source.bos_id(), source.eos_id(), source.unk_id()
        pieces = [source.id_to_piece(i) for i in range(n)]
        hidden = [source.is_control(i) or source.is_unknown(i) for i in range(n)]
        is_byte = [source.is_byte(i) for i in range(n)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.text = np.empty(n, dtype=object)
        for i, piece in enumerate(pieces):
            if is_byte[i]:
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            else:
                self.text[i] = b"" if hidden[i] else piece.replace(SPACE, " ").encode()
        self.hidden = np.array(hidden)
        plain = [i for i in range(n) if not is_byte[i] and not hidden[i]]
        scores = sorted({source.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        by_piece = {pieces[i]: i for i in plain}

        self._forget()
        # Symbols: a vocabulary id, or n + code point for a character that is no piece itself.
        self.size = n
        points = 0x110000
        self.char_symbol = np.arange(n, n + points, dtype=np.int64)
        for piece, i in by_piece.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
        symbol = lambda s: by_piece.get(s, n + ord(s) if len(s) == 1 else None)
        pairs = {}
        for piece, i in by_piece.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (order[source.get_score(i)], i)
        # A chained hash table; entry 0 stands for "no such pair".
        self.slot_keys = np.array([-1, *pairs], dtype=np.int64)
        self.pair_rank = np.array([NO_PAIR, *(r for r, _ in pairs.values())], dtype=np.int32)
        self.pair_id = np.array([-1, *(i for _, i in pairs.values())], dtype=np.int64)
        bits = max(4, int(len(pairs)).bit_length() + 2)
        self.hash_shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, dtype=np.int64)
        self.next_entry = np.zeros(len(self.slot_keys), dtype=np.int64)
        homes = ((self.slot_keys[1:].view(np.uint64) * HASH) >> self.hash_shift).astype(np.int64)
        for entry, home in enumerate(homes.tolist(), 1):
            self.next_entry[entry], self.slots[home] = self.slots[home], entry
        together = {(ord(a) << 32) | ord(b) for p in by_piece for a, b in zip(p, p[1:], strict=False)}
        self.together = np.array(sorted(together), dtype=np.int64)

    # -- encoding -------------------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_PAIR where the vocabulary has none."""
        keys = (left << 32) | right
        slot = ((keys.view(np.uint64) * HASH) >> self.hash_shift).astype(np.int64)
        entry = self.slots[slot]
        while True:
            miss = np.flatnonzero((self.slot_keys[entry] != keys) & (entry > 0))
            if not len(miss):
                break
            entry[miss] = self.next_entry[entry[miss]]
        return self.pair_rank[entry], self.pair_id[entry]

    def merge_rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the parts held in `symbols`; returns the symbols and the new length of each part."""
        parts = len(lengths)
        owner = np.repeat(np.arange(parts, dtype=np.int32), lengths)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), NO_PAIR, dtype=np.int32)
        merged = np.full(len(symbols), -1, dtype=np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], merged[inner] = self._look_up(symbols[inner], symbols[inner + 1])
        while len(symbols):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, start)
            live = best < NO_PAIR
            width = np.diff(np.r_[start, len(symbols)])
            if not live.all():
                stays = np.repeat(live, width)
                done_symbols.append(symbols[~stays])
                done_owner.append(owner[~stays])
                symbols, owner, rank, merged = symbols[stays], owner[stays], rank[stays], merged[stays]
                best, width = best[live], width[live]
                if not len(symbols):
                    break
                start = np.r_[0, np.cumsum(width)[:-1]]
            chosen = self._apart(rank == np.repeat(best, width))
            several = np.add.reduceat(chosen, start, dtype=np.int32) > 1
            state = self._merge(symbols, owner, rank, merged, chosen)
            if several.any():
                # Would a merge open a pair that the queue takes before the part's other merges?
                part_of = np.repeat(np.arange(len(width)), width)
                new_start = np.flatnonzero(np.r_[True, state[1][1:] != state[1][:-1]])
                early = np.minimum.reduceat(state[2], new_start) <= best
                # A merge also meets its right neighbour as it was before that one's own merge.
                at = np.flatnonzero(chosen[:-2] & (owner[:-2] == owner[2:])) if len(chosen) > 2 else np.zeros(0, dtype=np.int64)
                passing, _ = self._look_up(merged[at], symbols[at + 2])
                early[part_of[at[passing <= best[part_of[at]]]]] = True
                early &= several
                if early.any():
                    seen = np.cumsum(chosen)
                    first = chosen & (seen - np.repeat(seen[start] - chosen[start], width) == 1)
                    state = self._merge(symbols, owner, rank, merged, np.where(early[part_of], first, chosen))
            symbols, owner, rank, merged = state
        if not done_owner:
            return symbols, np.zeros(parts, dtype=np.int64)
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(owner, minlength=parts)

    @staticmethod
    def _apart(chosen: np.ndarray) -> np.ndarray:
        """Of runs of overlapping pairs, every second one from the left."""
        before = np.r_[False, chosen[:-1]]
        if not (chosen & before).any():
            return chosen
        at = np.arange(len(chosen))
        run_start = np.maximum.accumulate(np.where(chosen & ~before, at, -1))
        return chosen & ((at - run_start) % 2 == 0)

    def _merge(self, symbols, owner, rank, merged, chosen):
        """Merge the chosen pairs; only pairs beside a merge are looked up again."""
        kept = np.flatnonzero(~np.r_[False, chosen[:-1]])
        fresh = chosen[kept]
        out = np.where(fresh, merged[kept], symbols[kept])
        new_owner, new_rank, new_merged = owner[kept], rank[kept], merged[kept]
        touched = fresh.copy()
        touched[:-1] |= fresh[1:]
        at = np.flatnonzero(touched)
        new_rank[at] = NO_PAIR
        at = at[at < len(out) - 1]
        at = at[new_owner[at] == new_owner[at + 1]]
        new_rank[at], new_merged[at] = self._look_up(out[at], out[at + 1])
        return out, new_owner, new_rank, new_merged

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word_length = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        if not len(flat):
            return flat, word_length
        word_of = np.repeat(np.arange(len(words)), word_length)
        word_end = np.r_[word_of[1:] != word_of[:-1], True]
        cut = word_end.copy()
        inner = np.flatnonzero(~word_end)
        if len(inner):
            keys = (flat[inner] << 32) | flat[inner + 1]
            place = np.minimum(np.searchsorted(self.together, keys), len(self.together) - 1)
            cut[inner] = self.together[place] != keys
        ends = np.flatnonzero(cut) + 1
        lengths = np.diff(np.r_[0, ends])
        ids, counts = self.merge_rounds(self.char_symbol[flat], lengths)
        part_word = word_of[ends - 1]
        owner = np.repeat(part_word, counts)
        ids, owner = self._with_bytes(ids, owner)
        return ids, np.bincount(owner, minlength=len(words))

    def _with_bytes(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their UTF-8 bytes."""
        odd = ids >= self.size
        if not odd.any():
            return ids, owner
        points = ids[odd] - self.size
        coded = [chr(p).encode("utf-8", "replace") for p in points.tolist()]
        width = np.ones(len(ids), dtype=np.int64)
        width[odd] = [len(b) for b in coded]
        out = np.repeat(ids, width)
        out[np.repeat(odd, width)] = self.byte_id[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        return out, np.repeat(owner, width)

    def _forget(self) -> None:
        self.word_code = _Codes()
        self.word_ids, self.word_counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _known(self, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of all words of `index`; only those new since the last call are encoded."""
        ids, counts = self.encode_words([SPACE + w.replace(" ", SPACE) for w in islice(index, len(self.word_counts), None)])
        self.word_ids, self.word_counts = np.concatenate((self.word_ids, ids)), np.concatenate((self.word_counts, counts))
        return self.word_ids, self.word_counts

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text between the begin and end ids."""
        if len(self.word_code) > KNOWN_WORDS:
            self._forget()
        index = self.word_code
        codes: list[int] = []
        row_end = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                codes.extend(map(index.__getitem__, _words(text.replace(SPACE, " "))))
            row_end[i] = len(codes)
        ids, counts = self._known(index)
        begin = np.r_[0, np.cumsum(counts)]
        codes = np.asarray(codes, dtype=np.int64)
        width = counts[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        total = int(width.sum())
        shift = np.r_[0, np.cumsum(width)[:-1]] if len(width) else width
        flat = ids[np.arange(total) - np.repeat(shift, width) + np.repeat(begin[codes] if len(codes) else width, width)] if total else np.zeros(0, dtype=np.int64)
        edges = np.r_[0, np.cumsum(width)]
        at = np.r_[0, edges[row_end]] if len(texts) else np.zeros(1, dtype=np.int64)
        return [np.concatenate(([self.bos], flat[at[i] : at[i + 1]], [self.eos])) for i in range(len(texts))]

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: one leading space goes, control pieces are silent, stray bytes become U+FFFD."""
        shown = ids[~self.hidden[ids] | (ids == self.unk)]
        if (shown == self.unk).any():
            parts = [" ⁇ ".encode() if i == self.unk else self.text[i] for i in shown.tolist()]
        else:
            parts = self.text[shown].tolist()
        whole = b"".join(parts)
        from_space = len(shown) > 0 and shown[0] != self.unk and shown[0] not in self._byte_ids and whole[:1] == b" "
        whole = whole[1:] if from_space else whole
        try:
            return whole.decode("utf-8")
        except UnicodeDecodeError:
            return _with_replacements(whole)

    @property
    def _byte_ids(self) -> frozenset[int]:
        if not hasattr(self, "_bytes_set"):
            self._bytes_set = frozenset(self.byte_id.tolist())
        return self._bytes_set


def _with_replacements(data: bytes) -> str:
    """Valid UTF-8 characters as they are; every other byte on its own as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[at : at + width].decode("utf-8"))
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str | None, with_ids: bool, with_text: bool):
    def run(batches):
        pieces = model(path or default_model())
        for batch in batches:
            for part in slices(batch, ["text"], 8_000_000):
                coded = pieces.encode_texts([x or "" for x in part.column("text").to_pylist()])
                arrays, names = [part.column("doc_id"), pa.array([len(x) for x in coded], pa.int64())], ["doc_id", "n_tokens"]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in coded], pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    arrays += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]), pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in coded])]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, and `ids` and the two digests as asked for.

    Whole texts are encoded with begin and end ids; a null text counts as empty and has those two
    only. Null and repeated ids pass through; other columns are not read. The digests are the
    sha256 of the ids as little-endian unsigned 32-bit integers and of the text decoded from them.
    `model_path` must be readable on every executor; None takes the installed public model.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return rows.mapInArrow(_encode(model_path, ids, digests), schema)


def _decode(path: str | None):
    def run(batches):
        pieces = model(path or default_model())
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.asarray(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """One row per row of `coded`: doc_id, text. Null ids give a null text, an empty list the empty text."""
    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decode(model_path), f"doc_id {kind}, text string")
