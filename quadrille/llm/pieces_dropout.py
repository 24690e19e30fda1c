"""Merge-type piece encoding with seeded dropout, and its lossless decoding.

Characters are merged pairwise, highest piece score first, then leftmost. Each merge that
comes up is skipped with probability ``dropout``: a hash keyed by seed, document (id, text
and number of the copy), place of the word in the text and number of the merge says how
many merges pass before the next skipped one. So a seed fixes all segmentations, and every
occurrence of a word is split on its own. What is remembered is the outcome of a word
under given skips, which does not depend on who asks. Characters without a piece, and the
space mark itself, are written as UTF-8 bytes. Without dropout the ids equal those of
the public model. Null and empty text have no ids and decode to the empty string. An
empty table gives an empty result; rows that repeat are encoded each.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, kept, whole
from .pieces import MARK, MODEL, Vocabulary, model_bytes

DROPOUT, SEED = 0.1, 17
_M = (1 << 64) - 1
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Outcomes remembered by a worker, and units encoded at a time: bound memory, not results.
REMEMBERED, UNITS = 500_000, 200_000
#: Symbols up to which words are merged together, and how many words at a time.
SHORT, TOGETHER = 48, 8192
#: Bits of the hash that finds the pairs that make a piece.
BUCKETS = 21
#: The space mark as it stands in a text, kept apart from spaces until encoded.
_ESCAPED = "﷐"
_UNIT = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind, room: int = 1 << 16):
        self.all, self.n = np.zeros(room, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(max(end, 2 * self.n) - self.n, self.all.dtype)])
        self.all[self.n : end] = values
        self.n = end


class _Numbers(dict):
    """Numbers of words; new ones are noted, long ones (-1) each time they occur."""

    def __init__(self):
        self.new: list[str] = []
        self.long: list[str] = []
        self.first = 0

    def __missing__(self, word: str) -> int:
        if len(word) > SHORT:
            self.long.append(word)
            return -1
        n = self[word] = self.first + len(self.new)
        self.new.append(word)
        return n


class Codec:
    def __init__(self, proto: bytes, dropout: float = DROPOUT, seed: int = SEED):
        self.v = Vocabulary(proto)
        self.seed = seed
        # the hashes under which 0, 1, 2 .. merges pass before the next skipped one
        steps = [] if dropout <= 0 else [1.0] if dropout >= 1 else [1 - (1 - dropout) ** (k + 1) for k in range(4096)]
        self.gaps = sorted({min(int(x * 2**64), _M) for x in steps})
        self.gap_table = np.array(self.gaps, np.uint64)
        self.bytes = {i: p.replace(MARK, " ").encode() for i, p in self.v.piece.items()} | {i: bytes([b]) for i, b in self.v.of_byte.items()}
        self._tables()
        self._forget()

    def _tables(self) -> None:
        """Symbols as numbers: pieces by id, other characters of pieces behind them, all
        other characters 0; the pairs of symbols that make a piece, by hash."""
        pieces = self.v.id
        top = max(pieces.values()) + 1
        number = pieces | {c: top + k for k, c in enumerate(sorted({c for p in pieces for c in p} - pieces.keys()))}
        self.of_char = np.zeros(0x110000, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.is_piece = np.zeros(max(number.values()) + 1, bool)
        self.is_piece[list(pieces.values())] = True
        made = sorted((number[p[:k]] << 32 | number[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        pairs, merged = (np.array(x, np.int64) for x in zip(*made, strict=True))
        order = np.argsort(self._bucket(pairs), kind="stable")
        self.pairs, self.merged = np.append(pairs[order], -1), np.append(merged[order], 0)
        self.bucket = np.searchsorted(self._bucket(pairs)[order], np.arange((1 << BUCKETS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max())
        self.rank = np.zeros(top, np.int32)
        ids = list(pieces.values())
        self.rank[ids] = np.unique([self.v.score[p] for p in pieces], return_inverse=True)[1]

        top = max(self.bytes) + 1
        self.n_bytes = np.array([len(self.bytes.get(i, b"")) for i in range(top)], np.int64)
        self.byte_start = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(top)), np.uint8)

    @staticmethod
    def _bucket(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * _K[0] >> np.uint64(64 - BUCKETS)).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs make a piece, and which piece."""
        bucket = self._bucket(pairs)
        at, end = self.bucket[bucket], self.bucket[bucket + 1]
        who = np.nonzero(at < end)[0]
        found, piece = [], []
        for _ in range(self.deepest):
            i = at[who]
            hit = self.pairs[i] == pairs[who]
            found.append(who[hit])
            piece.append(self.merged[i[hit]])
            who = who[~hit]
            at[who] += 1
            who = who[at[who] < end[who]]
            if not len(who):
                break
        return np.concatenate(found), np.concatenate(piece)

    def _forget(self) -> None:
        """Outcomes by number: word, the outcome with one skip less and that skip (-1: none);
        where their ids lie in ``flat``; how many merges came up; where the outcomes with
        one skip more lie in ``after`` (-1: not yet asked). Number 0 is the escaped mark's."""
        self.known = _Numbers()
        self.word_of = []
        self.parent, self.last_skip = _Growing(np.int32), _Growing(np.int32)
        self.flat, self.start, self.count, self.tried = _Growing(np.int32), _Growing(np.int64), _Growing(np.int64), _Growing(np.int64)
        self.after, self.base = _Growing(np.int32), _Growing(np.int64)
        self.known[""] = 0
        self._add([""], *_plain(1), [tuple(self.v.byte[b] for b in _ESCAPED.encode())], np.zeros(1, np.int64))

    def _add(self, words: list[str], parents: np.ndarray, last: np.ndarray, ids: list, tried: np.ndarray) -> int:
        """Adds outcomes and returns the first one's number."""
        first = len(self.word_of)
        self.word_of += words
        self.parent.add(parents)
        self.last_skip.add(last)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.add(self.flat.n + np.cumsum(n) - n)
        self.count.add(n)
        self.flat.add(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))
        self.tried.add(tried)
        self.base.add(self.after.n + np.cumsum(tried) - tried)
        self.after.add(np.full(int(tried.sum()), -1, np.int32))
        return first

    def _next_skip(self, key: int, at: int) -> int:
        """Number of the first merge from ``at`` on that is skipped."""
        h = (key ^ (at + 1) * 0xC2B2AE3D27D4EB4F) & _M
        h = (h ^ h >> 31) * 0xD6E8FEB86659FD93 & _M
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & _M
        gap = bisect_right(self.gaps, h ^ h >> 32)
        return at + gap if gap < len(self.gaps) else _M

    def _next_skips(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``_next_skip`` of many keys; where there is none, a number beyond all merges."""
        h = keys ^ (at + 1).astype(np.uint64) * _K[1]
        h = (h ^ h >> np.uint64(31)) * _K[3]
        h = (h ^ h >> np.uint64(32)) * _K[3]
        h ^= h >> np.uint64(32)
        gap = np.searchsorted(self.gap_table, h, "right")
        gap[gap == len(self.gap_table)] = 1 << 40
        return at + gap

    def _key(self, variant: int) -> int:
        return (self.seed * 0x9FB21C651E98DF25 + variant * 0xE7037ED1A0B428DB) & _M

    def _keys(self, variant: int, n: int) -> np.ndarray:
        """A key for each of the ``n`` units of a text."""
        h = np.uint64(self._key(variant)) ^ (np.arange(1, n + 1, dtype=np.uint64) * _K[0])
        h = (h ^ h >> np.uint64(32)) * _K[2]
        return h ^ h >> np.uint64(29)

    def _ask(self, words: list[str], parents: np.ndarray, last: np.ndarray) -> int:
        """Merges words under the skips of their parents and a last one (-1: under none);
        words of like length together. The number of the first outcome."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order, ids, tried = np.argsort(lens, kind="stable"), [()] * len(words), np.zeros(len(words), np.int64)
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            skip = None
            if last[0] >= 0:
                skip = np.zeros((len(some), 3 * SHORT), bool)
                who, t, of = np.arange(len(some)), last[some], parents[some]
                while len(who):
                    skip[who, t] = True
                    t, of = self.last_skip.all[of], self.parent.all[of]
                    on = t >= 0
                    who, t, of = who[on], t[on], of[on]
            found, tried[some] = self._merged([words[k] for k in some.tolist()], skip)
            for k, x in zip(some.tolist(), found, strict=True):
                ids[k] = x
        return self._add(words, parents, last, ids, tried)

    def _outcomes(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """Numbers of the outcomes of words, each under its own key: first without skips,
        then with the first merge its key skips, the second and so on."""
        known = self.known
        known.first, known.new, known.long = len(self.word_of), [], []
        got = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            self._ask(known.new, *_plain(len(known.new)))
        if known.long:
            at = np.nonzero(got < 0)[0]
            ids = [self._ids(self._long(w, k)) for w, k in zip(known.long, keys[at].tolist(), strict=True)]
            got[at] = self._add(known.long, *_plain(len(ids)), ids, np.zeros(len(ids), np.int64)) + np.arange(len(ids))
        who = np.nonzero(self.tried.all[got])[0] if self.gaps else got[:0]
        keys, now = keys[who], got[who]
        at = np.zeros(len(who), np.int64)
        while len(who):
            skip = self._next_skips(keys, at)
            on = np.nonzero(skip < self.tried.all[now])[0]
            who, keys, now, skip = who[on], keys[on], now[on], skip[on]
            cell = self.base.all[now] + skip
            new = np.nonzero(self.after.all[cell] < 0)[0]
            if len(new):
                cells, one = np.unique(cell[new], return_index=True)
                of = now[new[one]]
                first = self._ask([self.word_of[o] for o in of.tolist()], of, skip[new[one]])
                self.after.all[cells] = np.arange(first, first + len(cells))
            now = got[who] = self.after.all[cell]
            at = skip + 1
        return got

    def _ids(self, symbols) -> tuple[int, ...]:
        piece_id, out = self.v.id, []
        for s in symbols:
            piece = piece_id.get(s)
            if piece is not None:
                out.append(piece)
            else:
                out += [self.v.byte[b] for b in s.replace(_ESCAPED, MARK).encode("utf-8", "surrogatepass")]
        return tuple(out)

    def many(self, words: list[str], variant: int) -> list[tuple[int, ...]]:
        """Ids of words under the key of ``variant``."""
        skips, at = np.zeros(3 * max(map(len, words)), bool), -1
        while (at := self._next_skip(self._key(variant), at + 1)) < len(skips):
            skips[at] = True
        return self._merged(words, np.tile(skips, (len(words), 1)))[0]

    def _merged(self, words: list[str], skips: np.ndarray | None) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The merges of ``_long``, a step of every word at once: the ids, and how many
        merges came up. Words lie in rows of one flat table, a place for each character
        and one without a symbol (-1) at both ends; ``best`` is the rank of the candidate
        merge of a symbol with the one after it, -1 where there is none. ``skips`` has the
        merges to skip, by their number."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max()) + 2
        inside = np.zeros((len(words), width), bool)
        inside[:, 1:] = np.arange(width - 1) < n[:, None]
        sym = np.full(inside.shape, -1, np.int64)
        sym[inside] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        best, inside, sym = np.full(sym.shape, -1, np.int32), inside.ravel(), sym.ravel()
        flat = best.ravel()
        into = np.zeros(len(sym), np.int64)
        after = np.arange(1, len(sym) + 1)
        before = after - 2
        tried = np.zeros(len(words), np.int64)

        def offer(at: np.ndarray) -> None:
            hit, piece = self._find(sym[at] << 32 | sym[after[at]])
            at = at[hit]
            flat[at], into[at] = self.rank[piece], piece

        offer(np.nonzero(inside)[0])
        rows = np.arange(len(words))
        while len(rows):
            at = rows * width + best[rows].argmax(axis=1)
            more = flat[at] >= 0
            rows, at = rows[more], at[more]
            if skips is not None:
                gone = skips[rows, tried[rows]]
                flat[at[gone]] = -1
                at = at[~gone]
            tried[rows] += 1
            right = after[at]
            then = after[right]
            sym[at], after[at], before[then] = into[at], then, at
            flat[right], inside[right] = -1, False
            both = np.concatenate([before[at], at])
            flat[both] = -1
            offer(both)

        places = np.nonzero(inside)[0]
        ends = np.searchsorted(places, np.arange(1, len(words) + 1) * width).tolist()
        found = sym[places]
        odd = np.unique(places[~self.is_piece[found]] // width).tolist()
        found = found.tolist()
        out = [tuple(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for r in odd:
            own = places[ends[r - 1] if r else 0 : ends[r]]
            out[r] = self._ids([words[r][a:b] for a, b in zip((own - r * width - 1).tolist(), (after[own] - r * width - 1).tolist(), strict=True)])
        return out, tried

    def long(self, word: str, variant: int) -> list[str]:
        return self._long(word, self._key(variant))

    def _long(self, word: str, key: int) -> list[str]:
        """Agenda of merges, a heap, over a linked list of symbols."""
        score, tried, push = self.v.score, 0, heapq.heappush
        skipped = self._next_skip(key, 0)
        sym: list = list(word)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j >= n:
                return
            both = sym[i] + sym[j]
            s = score.get(both)
            if s is not None:
                push(agenda, (-s, i, j, both))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != both:
                continue
            tried += 1
            if tried - 1 == skipped:
                skipped = self._next_skip(key, tried)
                continue
            sym[i], sym[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in sym if s is not None]

    def _split(self, text: str) -> list[str]:
        """Units of a text; the empty one stands for the noncharacter itself."""
        out: list[str] = []
        for k, part in enumerate(text.split(_ESCAPED) if text else ()):
            marked = part.replace(MARK, _ESCAPED).replace(" ", MARK)
            out += ["", *_UNIT.findall(marked)] if k else _UNIT.findall(MARK + marked)
        return out

    def encode(self, text: str, variant: int = 0) -> list[int]:
        return self.encode_all([text], [variant])[0]

    def encode_all(self, texts: list[str], variants: list[int]) -> list[list[int]]:
        """Ids of texts, each under the key of its own variant."""
        flat, ends = self.encode_flat(texts, variants)
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]

    def encode_flat(self, texts: list[str], variants: list[int]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts in one array, and where each text's end."""
        parts, ends, done, total = [], [], 0, 0
        split, held = [], 0
        for k, text in enumerate(texts):
            split.append(self._split(text))
            held += len(split[-1])
            if held >= UNITS or k == len(texts) - 1:
                flat, counts = self._encoded(split, variants[done : k + 1])
                parts.append(flat)
                ends += (total + np.cumsum(counts)).tolist()
                done, total = k + 1, total + len(flat)
                split, held = [], 0
        return np.concatenate(parts) if parts else np.empty(0, np.int32), ends

    def _encoded(self, split: list[list[str]], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.word_of) > REMEMBERED:
            self._forget()
        words = list(chain.from_iterable(split))
        if not words:
            return np.empty(0, np.int32), np.zeros(len(split), np.int64)
        keys = np.concatenate([self._keys(v, len(u)) for v, u in zip(variants, split, strict=True)])
        got = self._outcomes(words, keys)
        n = self.count.all[got]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = _gather(self.flat.all, self.start.all[got], n, upto)
        ends = upto[np.cumsum([0, *map(len, split)])]
        return flat, np.diff(ends)

    def decode_flat(self, flat: np.ndarray, ends: list[int]) -> list[bytes]:
        """UTF-8 of each text, of ids as ``encode_flat`` gives them."""
        n = self.n_bytes[flat]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = _gather(self.all_bytes, self.byte_start[flat], n, upto).tobytes()
        cut = upto[[0, *ends]].tolist()
        return [out[a + 1 : b] if b > a else b"" for a, b in zip(cut, cut[1:], strict=False)]  # the mark put before the first word

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text else text  # the mark put before the first word


def _plain(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neither parents nor skips of ``n`` outcomes."""
    return np.full(n, -1), np.full(n, -1)


def _gather(values: np.ndarray, start: np.ndarray, n: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """``values[start : start + n]`` of each, end to end."""
    at = np.ones(int(upto[-1]), np.int64)
    some = np.nonzero(n)[0]
    if not len(some):
        return values[:0]
    first = start[some]
    at[upto[some[1:]]] = first[1:] - (first[:-1] + n[some[:-1]] - 1)
    at[0] = first[0]
    return values[np.cumsum(at)]


def codec(proto: bytes, dropout: float, seed: int) -> Codec:
    """A worker's codec: it keeps what it remembers from task to task."""
    return kept(("codec", hash(proto), dropout, seed), lambda: Codec(proto, dropout, seed))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, lossless``, a row per input row; no shuffle. Rows that
    repeat id and text are split alike unless ``copy_col`` tells them apart."""
    spark = docs.sparkSession
    proto = model_bytes(spark, model)

    def run(batches):
        c = codec(proto, dropout, seed)
        for b in by_bytes(batches):
            texts, of = b.column(1).to_pylist(), b.column(2).to_pylist()
            flat, ends = c.encode_flat(texts, of)
            same = [x == t.encode() for x, t in zip(c.decode_flat(flat, ends), texts, strict=True)]
            ends = np.array([0, *ends], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "lossless"])

    kind = dict(docs.dtypes)[id_col]
    copy = [F.col(copy_col)] if copy_col else []
    variant = F.xxhash64(F.col(id_col).cast("string"), whole(text_col), *copy)
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), variant.alias("variant")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""
    proto = model_bytes(encoded.sparkSession, model)

    def run(batches):
        c = codec(proto, DROPOUT, SEED)
        for b in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op6(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir))
