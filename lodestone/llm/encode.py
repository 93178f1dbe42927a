"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

For a tokenizer that drops white space and never joins tokens across it, the ids of a text are those of its words
(runs without 0x20, 0x09-0x0D) one after another. So a slice of texts is cut into words, equal words are found by sorting
their 64-bit hashes, and only words that aren't in the cache go through the library, in one call for all of them. The cache is
a direct-mapped table: a word takes the place of another with the same low bits. Bytes decide whether words are equal, in a
slice and in the cache: a slice in which hashes collide is encoded as whole texts. Whether a tokenizer is of this kind is
read from its file; others encode whole texts. Words of letters a-z and ASCII punctuation alone are as a normaliser would leave them, and
where they are cut is plain to see, so where the file's splitting is the known one they go straight to its model.
"""

from __future__ import annotations

import json
import string

import numpy as np
from tokenizers import Tokenizer

from . import base

#: Places for words, ids that they may have together, and bytes for each of these, per process: words have more bytes than ids.
SLOTS, POOL, SPELLED = 1 << 21, 1 << 23, 3
_LOADED: dict[str, "Encoder"] = {}
_PUNCTUATION = string.punctuation.encode()
_KIND = np.full(256, 2, np.int8)  # 0: a letter a-z, 1: ASCII punctuation, 2: anything else
_KIND[list(string.ascii_lowercase.encode())] = 0
_KIND[list(_PUNCTUATION)] = 1


#: Fixed value: a splitting that cuts words of letters a-z and ASCII punctuation into runs of either, and leaves their bytes as they are.
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def _by_words(spec: dict) -> bool:
    """White space is squeezed, then dropped by the splitting pattern, letters are lowered, and no normaliser looks further."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and spec.get("truncation") is None


class Encoder:
    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = _by_words(spec)
        suffix = (spec["model"].get("end_of_word_suffix") or "") if self.by_words else ""
        self.ends = np.array([bool(suffix) and self.tokenizer.id_to_token(i).endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        known = self.by_words and spec["pre_tokenizer"] == _SPLIT and spec.get("post_processor") is None
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}})) if known else None
        self.key, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(pool, np.uint32), 0
        self.spelled, self.begin, self.length, self.bytes = np.zeros(SPELLED * pool, np.uint8), np.zeros(slots, np.int32), np.zeros(slots, np.int32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, words: list[bytes], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the number of pieces that the tokenizer cuts it into, where that is plain to see, else 0, and whether it can go to the model.

        Letters are a piece, and so is the run of ASCII punctuation behind them or by itself.
        """
        first = _KIND[buf[starts]]
        kind = _KIND[buf[base.ranges(starts, ends - starts)]]
        begins = np.cumsum(ends - starts) - (ends - starts)
        other = np.add.reduceat(kind == 2, begins) > 0
        turn = np.append(False, kind[1:] != kind[:-1])
        turn[begins] = False
        turns = np.add.reduceat(turn, begins)
        parts = np.where(~other & ((turns == 0) | ((turns == 1) & (first == 0))), turns + 1, 0)
        for k in np.flatnonzero(other).tolist():
            core = words[k].rstrip(_PUNCTUATION)
            if core.decode().isalpha():
                parts[k] = 1 + (len(core) < len(words[k]))
        return parts, (parts > 0) & ~other & (self.bare is not None)

    def _learned(self, words: list[bytes], parts: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has. A piece ends with its first token that ends a word."""

        def cut(k: int) -> bytes:
            core = words[k].rstrip(_PUNCTUATION)
            return core + b" " + words[k][len(core) :]

        sizes, found = np.zeros(len(words), np.int64), []
        for some, by in ((np.flatnonzero(bare), self.bare), (np.flatnonzero((parts > 0) & ~bare), self.tokenizer)):
            if not len(some):
                continue
            spelled = [cut(k) if n == 2 and by is self.bare else words[k] for k, n in zip(some.tolist(), parts[some].tolist(), strict=True)]
            ids = np.array(by.encode_batch_fast([b" ".join(spelled).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != parts[some].sum():  # not all were letters to the tokenizer, or it doesn't mark the ends of words
                each = [self._whole(w.decode()) for w in words]
                return np.concatenate(each), np.array([len(x) for x in each])
            sizes[some] = np.diff(stops[np.cumsum(parts[some]) - 1], prepend=0)
            found.append((some, ids))
        rest = np.flatnonzero(parts == 0)
        if len(found) == 1 and not len(rest):
            return found[0][1], sizes
        if len(rest):
            each = [self._whole(words[k].decode()) for k in rest.tolist()]
            sizes[rest] = [len(x) for x in each]
            found.append((rest, np.concatenate(each)))
        out, ends = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes)
        for some, ids in found:
            out[base.ranges(ends[some] - sizes[some], sizes[some])] = ids
        return out, sizes

    def _slice(self, rows: list[bytes | None]) -> list[bytes]:
        # ASCII letters lower alike everywhere; special tokens' strings are left alone
        rows = [r if not r or b"<|" in r else r.lower() for r in rows]
        buf, s, e, first = base.word_spans(rows)
        if not len(s):
            return [b""] * len(rows)
        word, example, of = np.unique(base.word_hashes(buf, s, e), return_index=True, return_inverse=True)
        a, z = s[example], e[example]
        long = np.flatnonzero(e - s > 8)  # shorter words of a length have different hashes
        if ((e - s) != (z - a)[of]).any() or not base.same_words(buf, s[long], e[long], buf, a[of[long]], z[of[long]]).all():
            return [self._whole(r.decode()).astype("<u4").tobytes() if r else b"" for r in rows]
        if self.used + 2 * len(buf) > len(self.pool) or self.bytes + len(buf) > len(self.spelled):
            self.key[:], self.used, self.bytes = 0, 0, 0
            if len(buf) > len(self.spelled):
                self.spelled = np.zeros(2 * len(buf), np.uint8)
        slot = (word & np.uint64(len(self.key) - 1)).astype(np.int64)
        known = self.key[slot] == word
        there = np.flatnonzero(known)
        begin = self.begin[slot[there]].astype(np.int64)
        known[there] = base.same_words(buf, a[there], z[there], self.spelled, begin, begin + self.length[slot[there]])
        new = np.flatnonzero(~known)
        at, size = self.at[slot], self.size[slot]
        if len(new):
            a, z = a[new], z[new]
            data = memoryview(buf)
            words = [bytes(data[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
            ids, sizes = self._learned(words, *self._parts(words, buf, a, z))
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(ids) + POOL, np.uint32)))
            self.pool[self.used : self.used + len(ids)] = ids
            at[new], size[new] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
            # of new words in one place the last stays
            self.key[slot[new]], self.at[slot[new]], self.size[slot[new]] = word[new], at[new], size[new]
            self.begin[slot[new]], self.length[slot[new]] = self.bytes + np.cumsum(z - a) - (z - a), z - a
            self.spelled[self.bytes : self.bytes + int((z - a).sum())] = buf[base.ranges(a, z - a)]
            self.bytes += int((z - a).sum())
        n = size[of].astype(np.int64)
        ids = self.pool[base.ranges(at[of].astype(np.int64), n)].astype("<u4").tobytes()
        cut = (4 * np.append(0, np.cumsum(n))[first]).tolist()
        return [ids[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]

    def many(self, rows: list[bytes | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [self._whole(r.decode()).astype("<u4").tobytes() if r else b"" for r in rows]
        out: list[bytes] = []
        for a, b in base.chunks(rows):
            out += self._slice(rows[a:b])
        return out

    def ids(self, row: bytes | None) -> bytes:
        return self.many([row])[0]


def encoder(path: str) -> Encoder:
    """One per process and file; tokenizer files are installed on every machine, their path is a parameter."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
