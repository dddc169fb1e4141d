"""Token ids of whole texts with a public tokenizer file, by word, remembering words.

The word-end tokenizer drops white space before it does anything else, so a text's ids are its words' ids in a row.
A worker remembers the ids of the words that it has met (two bounded tables, emptied when full) and hands only new
words to the tokenizer, many at once. Plain words of letters with ASCII punctuation after them are looked up by their
lower-case letters. Any other word goes through the unchanged tokenizer, so ids are equal to its own on every text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words and stems that are remembered, if not asked for otherwise. About 150 bytes an entry.
MAX_WORDS, MAX_STEMS = 600_000, 900_000

JOINED = 500

#: Latin-1 letters as UTF-8 (U+00C0 to U+00FF without the two signs): NFC leaves them, and lower case is one to one.
_LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_PLAIN = re.compile(rb"(" + _LATIN + rb")([!-&(-/:-;=?-@\[-`{-~]*)")  # neither ' nor < nor >: contractions, special tokens


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts by words. Only for tokenizers that drop white space before splitting (see `encoder`)."""

    def __init__(self, path: str, max_words: int | None = None, max_stems: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.max_words, self.max_stems = max_words or MAX_WORDS, max_stems or MAX_STEMS
        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_str(json.dumps(spec))
        end = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = token.endswith(end)
        self.bare, self.bytes_ = Tokenizer(self.whole.model), Tokenizer(self.whole.model)  # one model for all three
        self.bare.pre_tokenizer = WhitespaceSplit()  # for ASCII
        self.bytes_.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        got = self.whole.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _stems(self, bare, stems: list[bytes]) -> None:
        """Lower-case words of letters: joined, encoded at once and cut after each word's last token."""
        for at in range(0, len(stems), JOINED):
            some = stems[at : at + JOINED]
            ids = np.array(bare.encode_batch_fast([b" ".join(some).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # cannot be told apart: one by one
                self.stems.update(zip(some, self._whole(some), strict=True))
                continue
            raw, start = ids.tobytes(), 0
            for stem, cut in zip(some, (cuts * 4).tolist(), strict=True):
                self.stems[stem] = raw[start:cut]
                start = cut

    def learn(self, words: set[bytes]) -> None:
        known, stems = self.words, self.stems
        if len(known) + len(words) > self.max_words:
            known.clear()
        if len(stems) + len(words) > self.max_stems:
            stems.clear()
        odd, later, new, marks = [], [], set(), set()
        get = stems.get
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters
                stem, mark = w.lower(), b""
            elif w[:-1].isalpha() and w[-1] in b".,":
                stem, mark = w[:-1].lower(), w[-1:]
            elif m := _PLAIN.fullmatch(w):
                stem, mark = m[1].decode().lower().encode(), m[2]
            else:
                odd.append(w)
                continue
            ids = get(stem)
            end = get(mark) if mark else b""
            if ids is not None and end is not None:
                known[w] = ids + end
                continue
            later.append((w, stem, mark))
            if ids is None:
                new.add(stem)
            if end is None:
                marks.add(mark)
        stems.update(zip(marks, self._whole(list(marks)), strict=True))
        self._stems(self.bare, [x for x in new if x.isascii()])
        self._stems(self.bytes_, [x for x in new if not x.isascii()])
        for w, stem, mark in later:
            known[w] = stems[stem] + stems[mark] if mark else stems[stem]
        known.update(zip(odd, self._whole(odd), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        group: list[tuple[list[bytes], list[bytes | None]]] = []
        n, get = 0, self.words.get
        for text in texts:
            words = text.split()
            group.append((words, list(map(get, words))))
            n += len(words)
            if n > 200_000:
                self._flush(group, out)
                group, n = [], 0
        self._flush(group, out)
        return out

    def _flush(self, group: list[tuple[list[bytes], list[bytes | None]]], out: list[bytes]) -> None:
        gaps = [[i for i, ids in enumerate(got) if ids is None] for _, got in group]
        new = {words[i] for (words, _), at in zip(group, gaps, strict=True) for i in at}
        if new:
            self.learn(new)
        for (words, got), at in zip(group, gaps, strict=True):
            for i in at:
                got[i] = self.words[words[i]]
            out.append(b"".join(got))


class TextEncoder:
    """Encodes whole texts with any tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            some = [t.decode("utf-8", "replace") for t in texts[at : at + 64]]
            out += [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(some, add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, max_words: int | None = None, max_stems: int | None = None) -> WordEncoder | TextEncoder:
    """One for each worker process, file and size."""
    spec = json.load(open(path, encoding="utf-8"))
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = steps[0] if steps else {}
    by_words = (
        spec["model"].get("end_of_word_suffix") and normal == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split"
        and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and r"[\p{L}]+" in first["pattern"]["Regex"]
    )
    return WordEncoder(path, max_words, max_stems) if by_words else TextEncoder(path)
