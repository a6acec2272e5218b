"""Ids of texts by the tokenizers library, for the operators that pack them.

A text's chunks (what white space separates) encode on their own under the word vocabularies, so each
distinct chunk is encoded once and its ids are remembered as raw bytes; a text's ids are one join of them.
Chunks that are new in a slice of documents go to the library together, as one pre-split sequence; those of ASCII
and Latin-1 letters as one text, which it reads in about half the time, where the vocabulary marks the tokens that close a word.  A word that
differs from a known one only in the case of A-Z or in the marks behind it is put together from the known ids,
where the vocabulary is one that folds case and cuts marks off (which two probes tell).
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

SLICE = 1000
CHUNK_BYTES = 64
ENTRIES = 350_000
#: A word of ASCII letters, digits and Latin-1 letters (in UTF-8), and the marks behind it.
_WORD = rb"((?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)"
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_MARKED = re.compile(_WORD + rb"([.,!?;:#$%&*|]*)").fullmatch


class TokenIds:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.top = self.library.get_vocab_size(with_added_tokens=True)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        probe = self.library.encode("a  b\n c", add_special_tokens=False).ids
        if probe != [i for x in "abc" for i in self.library.encode(x, add_special_tokens=False).ids]:
            raise ValueError("this vocabulary's tokens hold white space")
        alike = lambda *texts: [i for x in texts for i in self.library.encode(x, add_special_tokens=False).ids]
        folds = all(alike(x) == alike(x.lower()) for x in ("Word", "WÖRD", "Id9", "PhD"))
        cuts = all(alike(x + y) == alike(x, y) for x in ("word", "wörd", "id9") for y in (".", ",", "!?", "...", "###", "&&&", ";:|"))
        self.derives = folds and cuts
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        #: By id, whether the token closes a word; none where the vocabulary does not mark that.
        self.closes: np.ndarray | None = None
        if suffix:
            self.closes = np.zeros(self.top, bool)
            self.closes[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, read as one text, and where each word ends; nothing where the closing tokens are not one a word."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, ends) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def forget(self) -> None:
        """Free the memo."""
        self.young, self.old = {}, {}

    def raw(self, texts: list[bytes | None], entries: int = ENTRIES) -> list[bytes]:
        """As ``_raw``, without walks of the garbage collector over the memo meanwhile."""
        gc.disable()
        try:
            return self._raw(texts, entries)
        finally:
            gc.enable()

    def _raw(self, texts: list[bytes | None], entries: int) -> list[bytes]:
        """The ids of each UTF-8 text as unsigned 32-bit numbers in the machine's byte order; at most ``SLICE`` texts a call keep memory bounded."""
        parts = [t.split() if t else [] for t in texts]  # ASCII white space; other white space stays in a chunk, where the library finds it
        wanted: set[bytes] = set()
        for p in parts:
            wanted.update(p)
        if len(self.young) > entries:
            self.young, self.old = {}, self.young
        once: dict[bytes, bytes] = {}
        young, old = self.young, self.old
        fresh: dict[bytes, None] = {}
        derived = []

        def want(form: bytes) -> None:
            if form not in young:
                known = old.get(form)
                if known is None:
                    fresh[form] = None
                else:
                    young[form] = known

        def keep(chunks: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(chunks, (4 * ends).tolist()):
                (young if len(chunk) <= CHUNK_BYTES else once)[chunk] = raw[start:end]
                start = end

        for chunk in wanted.difference(young):  # as against the dict's keys, walks the words of this slice and not the memo
            known = old.get(chunk)
            if known is not None:
                young[chunk] = known
            elif self.derives and not (chunk.isalpha() and chunk.islower()) and (found := _MARKED(chunk)) and (form := found[1].lower()) != chunk:
                derived.append((chunk, form, found[2]))
                want(form)
                if found[2]:
                    want(found[2])
            else:
                fresh[chunk] = None
        if fresh:
            plain = [c for c in fresh if c.isalpha() or _LETTERS(c)] if self.closes is not None else []
            if plain and (found := self._plain(plain)):
                keep(plain, *found)
                for chunk in plain:
                    del fresh[chunk]
            if rest := list(fresh):
                encoded = self.library.encode([c.decode() for c in rest], is_pretokenized=True, add_special_tokens=False)
                keep(rest, np.array(encoded.ids, np.uint32), np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(rest))))
        for chunk, form, marks in derived:
            ids = young[form] if len(form) <= CHUNK_BYTES else once[form]
            if marks:
                ids += young[marks] if len(marks) <= CHUNK_BYTES else once[marks]
            (young if len(chunk) <= CHUNK_BYTES else once)[chunk] = ids
        if once:
            return [b"".join([once[c] if c in once else self.young[c] for c in p]) if not once.keys().isdisjoint(p) else b"".join(map(self.young.__getitem__, p)) for p in parts]
        return [b"".join(map(self.young.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One for each vocabulary and worker process."""
    return TokenIds(path)
