"""Token ids of whole texts with a public vocabulary file, vectorised over distinct white-space-free pieces."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[tuple, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts exactly as the tokenizer does, each distinct piece once.

    Valid for tokenizers whose pre-tokens never hold white space and whose normaliser works
    within white-space-free pieces (NFC, white-space replacement and lower-casing do); texts with
    special-token strings or white space beyond ASCII are encoded whole. A vocabulary whose pieces
    can't be encoded alone (one that joins a space to the next word, say) is refused. The cache of
    pieces is bounded: beyond `most` entries it becomes the old one, from which pieces are taken over as they occur.
    """

    #: Encoded whole and in pieces when an encoder is made; the ids must agree.
    PROBE = "The cat's 12 hats, \u00fcber-Stra\u00dfe. x1 (a) \u4e2d\u6587 e\u0301! \u0130. End"

    #: Texts with these are encoded whole: special-token strings, and white space that is not ASCII.
    ODD = r"<\||[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"

    def __init__(self, path: str, specials_as_text: bool = False, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.most = most
        self.plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.latin = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]").fullmatch
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        ends = np.zeros(1 + max(words.values(), default=0), bool)
        for w, i in words.items():
            ends[i] = w.endswith("</w>")
        self.ends_word = ends if ends.any() else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if not np.array_equal(self.whole(self.PROBE), np.concatenate([self.whole(p) for p in self.PROBE.split()])):
            raise ValueError(f"pieces between white space can't be encoded alone with {path}")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. A piece that ends in a Latin letter and a closing mark is the piece without it, then the mark.

        Other letters are left alone: in lower case some end in a combining mark, which joins the closing one.
        """
        cache, todo, ends = self.cache, {}, []
        for p in pieces:
            q = p.lower() if p.isascii() else p
            if len(q) > 1 and q[-1] in ".,;:!?" and self.latin(q[-2]):
                ends.append((p, q[:-1], q[-1]))
                q = q[:-1]
                if (m := ends[-1][2]) not in cache:
                    todo[m] = None
            elif q != p:
                ends.append((p, q, ""))
            if q not in cache:
                if q in self.old:
                    cache[q] = self.old[q]
                else:
                    todo[q] = None
        # A piece of Latin lower-case letters is one pre-token, whose last id alone ends a word: many are encoded as one text.
        plain = [p for p in todo if self.plain(p)] if self.ends_word is not None else []
        for a in range(0, len(plain), 8192):
            part = plain[a : a + 8192]
            ids = self.whole(" ".join(part))
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(part):
                break  # not such a vocabulary: the way below does them
            data, x = ids.tobytes(), 0
            for p, y in zip(part, cuts.tolist()):
                cache[p] = data[4 * x : 4 * y]
                x = y
        new = [p for p in todo if p not in cache]
        for a in range(0, len(new), 4096):
            for p, e in zip(new[a : a + 4096], self.tokenizer.encode_batch_fast(new[a : a + 4096], add_special_tokens=False)):
                cache[p] = np.array(e.ids, np.uint32).tobytes()
        for p, q, m in ends:
            cache[p] = cache[q] + (cache[m] if m else b"")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as unsigned 32-bit, number of ids of each text); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.ODD))
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.ascii_split_whitespace(plain)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
        if len(self.cache) > self.most:
            self.old, self.cache = self.cache, {}
        self.cache[""] = b""
        missing = [p for p in pieces if p not in self.cache]
        if missing:
            old = self.old
            self.cache.update((p, old[p]) for p in missing if p in old)
            self._learn([p for p in missing if p not in old])
        parts = [self.cache[p] for p in pieces]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begins = np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begins[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        totals = np.concatenate([[0], ends])[offsets]
        counts = np.diff(totals)
        if odd.any():
            out = [self.whole(texts[i].as_py()) if odd[i] else ids[totals[i] : totals[i + 1]] for i in range(len(odd))]
            counts = np.array([len(x) for x in out], np.int64)
            ids = np.concatenate(out)
        return ids, counts


def encoder(path: str, specials_as_text: bool = False) -> PieceEncoder:
    """One encoder for each worker process, kept between tasks."""
    key = (path, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def append_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document, and the counts with it."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
