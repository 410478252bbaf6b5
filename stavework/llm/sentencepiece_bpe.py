"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where a merge can never reach across: no piece of the vocabulary holds a
space mark after another character, so ``marks + characters`` runs are independent
words. All words that a task has not met before go through the merge loop together, as
one flat array of symbol ids with a word number for each symbol:

1. rank every adjacent pair of a word (one sorted-array look-up for all pairs),
2. take each word's smallest rank (segmented minimum),
3. merge its occurrences from left to right, all words at once,
4. compact the arrays, and repeat until no pair is left.

The library merges one pair at a time, best score first and then leftmost. Merging
several occurrences in one round gives the same result unless a merge creates a pair
that is at least as good as the pair being merged; a word's round stops right behind
such a merge.

Words are encoded once per task and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stavework.llm.common import table, text_chunks, texts_of

SPACE = "▁"
#: Words per generation of a Python worker's cache; the older of two generations goes.
CACHE_WORDS = 200_000
#: Words of one merge loop: few enough that its arrays stay in the CPU's cache.
LOOP_WORDS = 4_000
#: Longer words are merged one pair at a time with a heap: rounds would be as many.
LONG_WORD = 400
NO_RANK = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """What merging needs of a model file."""

    ids: dict[str, int]  # normal pieces
    pieces: list[str]
    bytes_at: int  # id of byte 0x00, or -1
    unknown: int
    end: int
    pair_keys: np.ndarray  # hash table of left id * size + right id; -2 is a free slot
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    size: int
    risky: np.ndarray  # by id: a pair with this piece can be as good as the piece itself


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a BPE model whose normaliser is the identity with a leading space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
    ids = {p: i for i, p in enumerate(pieces) if not special[i]}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece holds a space mark after another character; words are not independent")
    if not np.array_equal(model.encode(" é  a\n"), model.encode("▁é▁▁a\n")):
        raise ValueError("the model normalises its input; only the identity is supported")
    scores = np.array([model.get_score(i) for i in range(size)])
    order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores, equal rank
    keys, ranks, made = [], [], []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            left, right = ids.get(piece[:k]), ids.get(piece[k:])
            if left is not None and right is not None:
                keys.append(left * size + right)
                ranks.append(order[i])
                made.append(i)
    first_byte = next((i for i in range(size) if model.is_byte(i)), -1)
    risky = np.zeros(size, dtype=bool)
    for key, rank in zip(keys, ranks, strict=True):
        for part in divmod(key, size):
            risky[part] |= rank <= order[part]
    slots = hash_slots(np.array(keys, dtype=np.int64))
    tables = [np.full(len(slots), -2, dtype=np.int64), np.full(len(slots), NO_RANK, dtype=np.int32), np.zeros(len(slots), dtype=np.int32)]
    for own, values in zip(tables, (keys, ranks, made), strict=True):
        own[slots >= 0] = np.array(values, dtype=own.dtype)[slots[slots >= 0]]
    return Vocabulary(ids, pieces, first_byte, model.unk_id(), model.eos_id(), *tables, size, risky)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (slots.bit_length() - 1))).view(np.int64)


def hash_slots(keys: np.ndarray) -> np.ndarray:
    """For each slot of an open-addressing table the number of its key, or -1."""
    slots = np.full(1 << (len(keys) * 8).bit_length(), -1, dtype=np.int64)
    left, at = np.arange(len(keys)), slot_of(keys, len(slots))
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]  # of keys for one slot the last gets it
        again = slots[at] != left
        left, at = left[again], (at[again] + 1) % len(slots)
    return slots


def pair_lookup(voc: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and merged ids of pairs; NO_RANK where there is no such piece."""
    keys = left.astype(np.int64) * voc.size + right
    keys[(left < 0) | (right < 0)] = -1
    at = slot_of(keys, len(voc.pair_keys))
    found = voc.pair_keys[at]
    wrong = np.flatnonzero((found != keys) & (found != -2))
    while len(wrong):
        at[wrong] = (at[wrong] + 1) % len(voc.pair_keys)
        found = voc.pair_keys[at[wrong]]
        wrong = wrong[(found != keys[wrong]) & (found != -2)]
    return voc.pair_ranks[at], voc.pair_ids[at]


def merge_rounds(voc: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words to the end.

    sym: symbol ids, -1 - k for character k that is no piece; word: the symbols' word
    numbers, ascending. Returns both for the final symbols, in order.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        inner = word[:-1] == word[1:]
        rank, made = pair_lookup(voc, sym[:-1], sym[1:])
        rank[~inner] = NO_RANK
        starts = np.flatnonzero(np.r_[True, ~inner])
        lengths = np.diff(np.r_[starts, len(sym)])
        rank = np.r_[rank, np.int32(NO_RANK)]  # one entry for each symbol
        least = np.minimum.reduceat(rank, starts)
        alive = np.repeat(least != NO_RANK, lengths)
        if not alive.all():  # finished words leave the loop
            done.append((sym[~alive], word[~alive]))
            keep = np.flatnonzero(alive)
            if not len(keep):
                break
            sym, word, rank = sym[keep], word[keep], rank[keep]
            made = np.r_[made, 0][keep]
            least, lengths = least[least != NO_RANK], lengths[least != NO_RANK]
        else:
            made = np.r_[made, 0]
        hits = np.flatnonzero(rank == np.repeat(least, lengths))
        # of hits that touch (a a a), every other one from the left
        new_run = np.r_[True, np.diff(hits) != 1]
        run_at = np.flatnonzero(new_run)
        offset = np.arange(len(hits)) - np.repeat(run_at, np.diff(np.r_[run_at, len(hits)]))
        hits = hits[offset % 2 == 0]
        # a merge whose new pair is at least as good, as seen at the time of that merge
        n, at_word = len(sym), word[hits]
        better = np.zeros(len(hits), dtype=bool)
        check = np.flatnonzero(voc.risky[made[hits]])
        if len(check):
            at, target = hits[check], rank[hits[check]]
            after, before = np.minimum(at + 2, n - 1), np.maximum(at - 1, 0)
            ok = (at + 2 < n) & (word[after] == word[at])
            better[check[ok]] |= pair_lookup(voc, made[at[ok]], sym[after[ok]])[0] <= target[ok]
            fused = np.zeros(n, dtype=bool)
            fused[hits + 1] = True
            left_sym = np.where(fused[before], made[np.maximum(before - 1, 0)], sym[before])
            ok = (at > 0) & (word[before] == word[at])
            better[check[ok]] |= pair_lookup(voc, left_sym[ok], made[at[ok]])[0] <= target[ok]
        if better.any():  # keep a word's hits up to its first such merge
            count = np.cumsum(better) - better
            first = np.flatnonzero(np.r_[True, at_word[1:] != at_word[:-1]])
            base = np.repeat(count[first], np.diff(np.r_[first, len(hits)]))
            hits = hits[count == base]
        sym = sym.copy()
        sym[hits] = made[hits]
        stay = np.ones(n, dtype=bool)
        stay[hits + 1] = False
        sym, word = sym[stay], word[stay]
    if not done:
        return sym, word
    sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(word, kind="stable")
    return sym[by], word[by]


def merge_long(voc: Vocabulary, sym: list[int]) -> list[int]:
    """The same merges for one long word, one at a time: best rank, then leftmost."""
    n = len(sym)
    follow, back = [*range(1, n), -1], list(range(-1, n - 1))
    rank, made = pair_lookup(voc, np.array(sym[:-1]), np.array(sym[1:]))
    heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != NO_RANK]
    heapq.heapify(heap)
    table_of: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int) -> None:
        j = follow[i]
        if j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        pair = (sym[i], sym[j])
        if pair not in table_of:
            r, m = pair_lookup(voc, np.array([pair[0]]), np.array([pair[1]]))
            table_of[pair] = int(r[0]), int(m[0])
        r, m = table_of[pair]
        if r != NO_RANK:
            heapq.heappush(heap, (r, i, *pair, m))

    gone = [False] * n
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = follow[i]
        if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i], gone[j] = m, True
        follow[i] = follow[j]
        if follow[j] >= 0:
            back[follow[j]] = i
        if back[i] >= 0:
            offer(back[i])
        offer(i)
    return [s for s, g in zip(sym, gone, strict=True) if not g]


class Encoder:
    """Words to ids, with a bounded cache of what has been encoded."""

    def __init__(self, path: str):
        self.voc = vocabulary(path)
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _fallback(self, character: str) -> list[int]:
        if self.voc.bytes_at < 0:
            return [self.voc.unknown]
        return [self.voc.bytes_at + b for b in character.encode()]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each independent of the others."""
        voc, ids = self.voc, self.voc.ids
        out: list[list[int] | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for lo in range(0, len(short), LOOP_WORDS):
            some = short[lo : lo + LOOP_WORDS]
            characters = "".join(words[i] for i in some)
            sizes = np.array([len(words[i]) for i in some])
            points = np.frombuffer(characters.encode("utf-32-le"), dtype=np.uint32)
            distinct, inverse = np.unique(points, return_inverse=True)
            sym = np.array([ids.get(chr(c), -1 - k) for k, c in enumerate(distinct.tolist())], dtype=np.int64)[inverse]
            rare = {-1 - k: self._fallback(chr(c)) for k, c in enumerate(distinct.tolist()) if chr(c) not in ids}
            sym, word = merge_rounds(voc, sym, np.repeat(np.arange(len(some)), sizes))
            ends = np.searchsorted(word, np.arange(len(some)), side="right").tolist()
            flat, start = sym.tolist(), 0
            has_rare = set(word[sym < 0].tolist())
            for k, end in enumerate(ends):
                got = flat[start:end]
                out[some[k]] = got if k not in has_rare else [x for s in got for x in (rare[s] if s < 0 else (s,))]
                start = end
        for i, w in enumerate(words):
            if out[i] is None:
                rare = {c: -1 - k for k, c in enumerate(sorted(set(w))) if c not in ids}
                own = {v: self._fallback(c) for c, v in rare.items()}
                got = merge_long(voc, [ids[c] if c in ids else rare[c] for c in w])
                out[i] = [x for s in got for x in (own[s] if s < 0 else (s,))]
        return out  # type: ignore[return-value]

    def split(self, text: str) -> list[str]:
        """The independent words of a text, with the model's leading space mark."""
        if not text:
            return []
        return _WORDS.findall(SPACE + text.replace(" ", SPACE))

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids as decimals joined by a space, without the end id."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        missing = set().union(*split).difference(known)
        kept = missing.intersection(older)
        known.update((w, older[w]) for w in kept)
        new = list(missing - kept)
        for w, ids in zip(new, self.encode_words(new), strict=True):
            known[w] = " ".join(map(str, ids))
        get = known.__getitem__
        for words in split:
            yield " ".join(map(get, words))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte runs read as UTF-8, control ids left out."""
        voc, parts, run = self.voc, [], bytearray()
        first = True
        for i in [*ids, -1]:
            if 0 <= i - voc.bytes_at < 256 and voc.bytes_at >= 0:
                run.append(i - voc.bytes_at)
                first = False
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if i < 0 or voc.pieces[i] not in voc.ids:
                if i == voc.unknown:
                    parts.append(" ⁇ ")
                    first = False
                continue
            piece = voc.pieces[i]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            parts.append(piece.replace(SPACE, " "))
        return "".join(parts)


def _utf8(data: bytes) -> str:
    """Bytes as UTF-8, one replacement character for each byte that does not fit."""
    out = ""
    while data:
        try:
            return out + data.decode()
        except UnicodeDecodeError as e:
            out += data[: e.start].decode() + "�"
            data = data[e.start + 1 :]
    return out


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Token ids of whole texts.

    docs: ``doc_id``, ``text`` and any other columns, which are not read. Returns
    ``doc_id``, ``ids`` (array<int>, closed by the end id). A null or empty text gives
    the end id alone; repeated rows give repeated rows; an empty table gives an empty
    one. ``model`` is the path of the model file, the same on all executors.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in text_chunks(batches):
            texts = [t.decode() for t in texts_of(batch)]
            rows = [f"{ids} {own.voc.end}" if ids else str(own.voc.end) for ids in own.encode_texts(texts)]
            flat = np.fromstring(" ".join(rows), dtype=np.int32, sep=" ")
            bounds = np.cumsum([0] + [r.count(" ") + 1 for r in rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """Texts of ``ids``: ``doc_id``, ``text``. Null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def round_trip_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode and decode whole texts in one pass; digests instead of the arrays.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. The decoder
    gets each distinct word's ids once per batch: byte runs never cross a word, so
    decoding word by word is decoding the whole.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in text_chunks(batches):
            texts = [t.decode() for t in texts_of(batch)]
            counts, ids_sha, text_sha = [], [], []
            for ids in own.encode_texts(texts):
                ids = f"{ids} {own.voc.end}" if ids else str(own.voc.end)
                counts.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode_string(own, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, type=pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_string(own: Encoder, ids: str) -> str:
    """Decode decimals joined by a space; pieces come from a table by decimal."""
    pieces = _piece_table(own)
    try:
        text = "".join(map(pieces.__getitem__, ids.split(" ")))
    except KeyError:  # bytes or unknown ids among them
        return own.decode(list(map(int, ids.split(" "))))
    return text[1:] if text.startswith(" ") else text


def _piece_table(own: Encoder) -> dict[str, str]:
    if not hasattr(own, "_pieces"):
        own._pieces = {str(i): p.replace(SPACE, " ") for p, i in own.voc.ids.items()} | {str(own.voc.end): ""}
        if own.voc.bytes_at >= 0:  # an ASCII byte is a character of its own
            own._pieces |= {str(own.voc.bytes_at + b): chr(b) for b in range(128)}
    return own._pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
