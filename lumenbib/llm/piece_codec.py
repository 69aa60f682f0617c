"""SentencePiece BPE inside a task: merge rounds over flat numpy symbol arrays, and decoding.

All words of a batch lie in one flat array of symbols. A round finds the smallest pair rank of each word (a
segmented minimum), merges its leftmost non-overlapping places in all words at once and closes the gaps; it ends
when no pair of any word is in the vocabulary. That equals the library's one-merge-at-a-time order as long as no
merge of a round creates a pair that is due before the rest of that round; words where it does (runs of pieces with
tied scores) are finished by a priority queue.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np

from lumenbib.llm.words import Memo

SPACE = "▁"
NO_PAIR = np.int32(2**31 - 1)


class KeyTable:
    """Position of each of many non-negative keys in a fixed list, -1 where absent: open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        self.keys = np.append(keys, -1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            wait = self.slots[at] != left
            left, at = left[wait], (at[wait] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = self.slots[at[left]]
            left = left[(found[left] >= 0) & (self.keys[found[left]] != keys[left])]
        return found


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.end_id = model.eos_id()
        self.unknown_id = model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(size)]
        byte_ids = [model.is_byte(i) for i in range(size)]
        plain = {
            p: i
            for i, p in enumerate(pieces)
            if not (byte_ids[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # Characters that only occur inside pieces are symbols too, though they are no ids.
        symbols = dict(plain)
        for c in sorted({c for p in plain for c in p} - plain.keys()):
            symbols[c] = len(symbols) + size
        self.base = max(symbols.values()) + 1
        self.vocabulary = size
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        scores = {p: model.get_score(i) for p, i in plain.items()}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs, beside = {}, set()
        for p, i in plain.items():
            for k in range(1, len(p)):
                beside.add(symbols[p[k - 1]] * self.base + symbols[p[k]])
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (place[scores[p]], i)
        self.pairs = KeyTable(np.array(list(pairs), np.int64))
        self.pair_ranks = np.array([*(r for r, _ in pairs.values()), NO_PAIR], np.int32)
        self.pair_into = np.array([*(i for _, i in pairs.values()), -1], np.int32)
        self.beside = KeyTable(np.array(list(beside), np.int64))
        self.surface = [
            bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() if p in plain else b""
            for p, b in zip(pieces, byte_ids, strict=True)
        ]
        self.surface[self.unknown_id] = " ⁇ ".encode()
        inner = {c for p in plain if len(p) > 1 for c in p}
        stop = "".join(c for c in "\n\t\r" if c not in inner)
        later = any(SPACE in p.lstrip(SPACE) for p in plain)
        if later:  # a piece may reach over a space: the text is one word
            self.split = re.compile(r"(?s).+").findall
        else:
            # Marks that never follow a letter or digit inside a piece start a word of their own.
            after = {b for p in plain for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
            marks = re.escape("".join(c for c in ".,;:!?" if c not in after))
            marks = f"[{marks}]" if marks else "(?!)"
            self.split = re.compile(
                f" *[^\\W_{stop}]+(?={marks})| +[^ {stop}]*|[{stop}]+|[^ {stop}]+" if stop else " +[^ ]*|[^ ]+"
            ).findall
        self.digits = [b"%d " % i for i in range(size)]
        self.memo = Memo(self._describe)

    # ------------------------------------------------------------------ merging

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; ``NO_PAIR`` where the two do not merge."""
        at = self.pairs.find(left.astype(np.int64) * self.base + right)
        at[(left < 0) | (right < 0)] = -1
        return self.pair_ranks[at], self.pair_into[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and where each word's ids start (one more entry than words)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.char_symbol[codes]
        start = np.arange(len(codes))
        if not len(codes):
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        # No merge crosses two characters that stand side by side in no piece: segments end there.
        key = sym[:-1].astype(np.int64) * self.base + sym[1:]
        joined = (self.beside.find(key) >= 0) & (sym[:-1] >= 0) & (sym[1:] >= 0) & (word[1:] == word[:-1])
        seg = np.concatenate([[0], np.cumsum(~joined)])
        out_sym, out_start = [], []
        rank = np.full(len(sym), NO_PAIR, np.int32)
        into = np.full(len(sym), -1, np.int32)
        rank[:-1], into[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[:-1][~joined] = NO_PAIR
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            counts = np.diff(np.append(heads, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, heads), counts)
            over = low == NO_PAIR
            if over.any():
                out_sym.append(sym[over])
                out_start.append(start[over])
                live = ~over
                sym, start, seg, rank, into, low = (x[live] for x in (sym, start, seg, rank, into, low))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            run = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(hit - hit[np.flatnonzero(run)][np.cumsum(run) - 1]) % 2 == 0]
            queued = self._out_of_turn(sym, seg, into, low, hit)
            if len(queued):
                slow = np.isin(seg, queued)
                for s, b in self._one_by_one(sym[slow], start[slow], seg[slow]):
                    out_sym.append(s)
                    out_start.append(b)
                hit = hit[~slow[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            sym[hit] = into[hit]
            if len(queued):
                gone |= slow
            new = np.zeros(len(sym), bool)
            new[hit] = True
            kept = ~gone
            sym, start, seg, rank, into, new = (x[kept] for x in (sym, start, seg, rank, into, new))
            if not len(sym):
                break
            changed = new.copy()
            changed[:-1] |= new[1:]
            at = np.flatnonzero(changed)
            rank[at], into[at] = NO_PAIR, -1
            at = at[at < len(sym) - 1]
            at = at[seg[at] == seg[at + 1]]
            rank[at], into[at] = self._pairs(sym[at], sym[at + 1])
        sym, start = np.concatenate(out_sym), np.concatenate(out_start)
        order = np.argsort(start, kind="stable")
        return self._ids(sym[order], start[order], codes, word, len(words))

    def _out_of_turn(self, sym, seg, into, low, hit) -> np.ndarray:
        """Segments with several merges in this round of which one makes a pair that is due at once."""
        own = seg[hit]
        several = np.zeros(len(hit), bool)
        same = own[1:] == own[:-1]
        several[1:] |= same
        several[:-1] |= same
        hit = hit[several]
        if not len(hit):
            return hit
        made = np.full(len(sym) + 2, -1, np.int32)
        made[hit] = into[hit]
        before = np.where((hit >= 2) & (made[hit - 2] >= 0) & (seg[hit - 2] == seg[hit]), made[hit - 2], sym[hit - 1])
        left = self._pairs(before, into[hit])[0]
        left[(hit == 0) | (seg[hit - 1] != seg[hit])] = NO_PAIR
        after = np.minimum(hit + 2, len(sym) - 1)
        right = self._pairs(into[hit], sym[after])[0]
        right[(hit + 2 >= len(sym)) | (seg[after] != seg[hit])] = NO_PAIR
        return np.unique(seg[hit[(left <= low[hit]) | (right <= low[hit])]])

    def _one_by_one(self, sym, start, seg):
        """The rest of some segments by a priority queue: best rank first, then leftmost."""
        heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        for a, b in zip(heads, np.append(heads[1:], len(sym)), strict=True):
            s = sym[a:b].tolist()
            after, before = [*range(1, len(s)), -1], list(range(-1, len(s) - 1))
            queue: list[tuple[int, int, int, int, int]] = []

            def offer(i, j, s=s, queue=queue):
                r, m = self._pairs(np.array([s[i]]), np.array([s[j]]))
                if m[0] >= 0:
                    heapq.heappush(queue, (int(r[0]), i, s[i], s[j], int(m[0])))

            for i in range(len(s) - 1):
                offer(i, i + 1)
            while queue:
                _, i, left, right, made = heapq.heappop(queue)
                j = after[i]
                if s[i] != left or j < 0 or s[j] != right:
                    continue
                s[i], s[j], after[i] = made, None, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                    offer(i, after[i])
                if before[i] >= 0:
                    offer(before[i], i)
            left = [i for i, x in enumerate(s) if x is not None]
            yield np.array([s[i] for i in left], np.int32), start[a:b][left]

    def _ids(self, sym, start, codes, word, n):
        """Symbols become ids; a character without one becomes its bytes."""
        bare = np.flatnonzero((sym < 0) | (sym >= self.vocabulary))
        own = word[start]
        if not len(bare):
            return sym.astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[start[bare]]]
        width = np.ones(len(sym), np.int64)
        width[bare] = [len(x) for x in spelled]
        ids = np.repeat(sym.astype(np.int64), width)
        first = np.cumsum(width) - width
        at = np.repeat(first[bare], width[bare]) + np.concatenate([np.arange(len(x)) for x in spelled])
        ids[at] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(own, weights=width, minlength=n).astype(np.int64))])

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece reaches across; the text gets the usual space in front."""
        return self.split(" " + text.replace(SPACE, " ")) if text else []

    def _describe(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Per word: its ids in decimal, a space after each, and what they decode to."""
        ids, ends = self.merge(words)
        out = []
        for spelled in (self.digits, self.surface):
            parts = list(map(spelled.__getitem__, ids.tolist()))
            edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])[ends].tolist()
            whole = b"".join(parts)
            out.append([whole[a:b] for a, b in zip(edge, edge[1:], strict=False)])
        return list(zip(*out, strict=True))

    # ------------------------------------------------------------------ whole texts

    def known(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        parts = [self.words(t) for t in texts]
        flat, k, out = self.memo([w for p in parts for w in p]), 0, []
        for p in parts:
            out.append(flat[k : k + len(p)])
            k += len(p)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        spelled = (b"".join([x[0] for x in own]) for own in self.known(texts))
        return [np.array([*map(int, s.split()), self.end_id], np.int32) for s in spelled]

    def digests(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Per text: how many ids, the ids in decimal joined by a space (end id last), the decoded text."""
        end, out = self.digits[self.end_id][:-1], []
        for own in self.known(texts):
            ids = b"".join([x[0] for x in own]) + end
            out.append((ids.count(b" ") + 1, ids, self.text_of(own)))
        return out

    @staticmethod
    def text_of(known: list[tuple[bytes, bytes]]) -> bytes:
        whole = b"".join([x[1] for x in known])
        return whole[1:] if whole[:1] == b" " else whole

    def decode(self, ids) -> str:
        """Text of ids; control ids say nothing, bytes that form no character become the replacement mark."""
        whole = b"".join([self.surface[int(i)] for i in ids])
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec a Python worker, whatever the number of tasks."""
    return PieceCodec(path)
