"""BPE encoding and decoding with exact merges in linear time.

Encoding never replays merges.  An Aho-Corasick automaton over the vocabulary lists every token that
occurs in a piece; the encoder takes the longest one at each place whose *pair* with the token before
it is compatible, and steps back where none is.  Two tokens are compatible when joining their strings
would not make the merge procedure fuse anything across the seam; a sequence of tokens is the merge
procedure's result exactly when each neighbouring pair is compatible, and every prefix has one such
sequence only, so a place that once led nowhere never needs a second visit and the work is linear.

Decoding looks tokens up in one byte table through an offset table.

Vocabulary files are JSON files of the ``tokenizers`` library (byte-level BPE, with or without an
end-of-word suffix).  Their path is a parameter and is read on each executor.

Defined results: a null text is encoded as the empty text; the empty text has no ids and decodes to the
empty string; rows are never merged, so repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the end-of-word suffix inside the automaton (a private-use code point; the mapped alphabet has none).
END = ""
#: White space that str.split() knows and the tokenizers' pattern engine does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
ENGINE_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: The two published pre-tokenisation patterns.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and signs that every Unicode version knows.
KNOWN = frozenset(map(chr, range(0x180)))
CACHE_ENTRIES = 300_000
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks and keeps between one and two times ``entries`` of the latest keys."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES) -> None:
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class BpeTables:
    """Vocabulary, merges and the pair-compatibility table of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        model = self.spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies can be encoded")
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            if made in self.parts:
                raise ValueError(f"token {made} is made by two merges")
            self.merges[vocab[left], vocab[right]] = (rank, made)
            self.parts[made], self.born[made] = (vocab[left], vocab[right]), rank
        self.form: dict[int, str] = {}
        for string, token in vocab.items():
            if token not in self.parts:
                ends = bool(suffix) and len(string) > len(suffix) and string.endswith(suffix)
                self.form[token] = string[: -len(suffix)] + END if ends else string
                self.born[token] = -1
        for token in sorted(self.parts, key=self.born.get):
            left, right = self.parts[token]
            self.form[token] = self.form[left] + self.form[right]
        self.suffixed = bool(suffix)
        self.base = {form: token for token, form in self.form.items() if token not in self.parts}
        #: Strings that the merge procedure turns into the one token of that string: the proof runs the merges once.
        self.whole = {form: token for token, form in self.form.items() if self.merged(form) == [token]}
        self.automaton = ahocorasick.Automaton()
        for form, token in self.whole.items():
            self.automaton.add_word(form, (len(form), token))
        self.automaton.make_automaton()
        self.length = {token: len(form) for form, token in self.whole.items()}
        self.pairs: dict[int, bool] = {}
        self.top = max(self.names) + 1
        self.spines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}

    def symbols(self, form: str) -> list[int]:
        if self.suffixed and form.endswith(END):
            return [*(self.base[c] for c in form[:-2]), self.base[form[-2:]]]
        return [self.base[c] for c in form]

    def merged(self, form: str) -> list[int]:
        """The merge procedure itself: used once for each vocabulary string, and in tests."""
        try:
            ids = self.symbols(form)
        except KeyError:
            return []
        while len(ids) > 1:
            best = min((m for pair in zip(ids, ids[1:]) if (m := self.merges.get(pair))), default=None)
            if best is None:
                break
            pair, out, i = self.parts[best[1]], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The symbols that stand at one end of a token while it is built: (symbol, rank that makes it, rank that consumes it)."""
        found = self.spines.get((token, side))
        if found is None:
            found, until, at = [], float("inf"), token
            while True:
                found.append((at, self.born[at], until))
                if at not in self.parts:
                    break
                until, at = self.born[at], self.parts[at][side]
            self.spines[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge joins the last symbols of ``left`` to the first of ``right`` while both are built."""
        known = self.pairs.get(left * self.top + right)
        if known is None:
            known, merges = True, self.merges
            for x, x_born, x_gone in self.spine(left, 1):
                for y, y_born, y_gone in self.spine(right, 0):
                    made = merges.get((x, y))
                    if made is not None:
                        at = max(made[0], x_born, y_born)
                        # With equal ranks the leftmost pair goes first, and the seam is left of what is inside ``right``.
                        if at < x_gone and (at < y_gone or made[0] == y_gone):
                            known = False
                            break
                if not known:
                    break
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[left * self.top + right] = known
        return known

    def encode_form(self, form: str) -> tuple[int, ...]:
        whole = self.whole.get(form)
        if whole is not None:
            return (whole,)
        size = len(form)
        options: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for end, match in self.automaton.iter(form):
            options[end + 1 - match[0]].append(match)
        out: list[int] = []
        taken: list[int] = []
        dead: set[int] = set()
        at, i, last, pairs, top = 0, len(options[0]) - 1, -1, self.pairs, self.top
        while at < size:
            here = options[at]
            while i >= 0:
                length, token = here[i]
                if at + length not in dead:
                    fits = last < 0 or pairs.get(last * top + token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                i -= 1
            if i >= 0:
                out.append(token)
                taken.append(i)
                last = token
                at += length
                i = len(options[at]) - 1
            else:
                if not out:
                    raise ValueError("a symbol of the text is not in the vocabulary")
                dead.add(at)
                at -= self.length[out.pop()]
                last = out[-1] if out else -1
                i = taken.pop() - 1
        return tuple(out)


class BpeCodec:
    """Encoder and decoder of one vocabulary file, equal to the tokenizers library without added special tokens."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.tables = BpeTables(path)
        self.letters = byte_alphabet()
        self.alphabet = {b: c for b, c in enumerate(self.letters)}
        self.library = None
        specials = sorted(self.tables.specials, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.lowers = self.tables.suffixed
        self.pieces_of = regex.compile(WORD_PATTERN if self.lowers else BYTE_PATTERN).findall
        self.piece_ids = Memo(self._encode_piece)
        self.chunk_ids = Memo(self._encode_chunk)
        top = max(self.tables.names) + 1
        self.offsets, blob = [0], bytearray()
        for i in range(top):
            blob += self.tables.names.get(i, "").encode()
            self.offsets.append(len(blob))
        self.blob = bytes(blob)
        self.decimals = [b"%d" % i for i in range(top)]
        self.slices = [self.blob[a:b] for a, b in zip(self.offsets, self.offsets[1:])]

    def _mapped(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        return self.tables.encode_form(self._mapped(piece) + (END if self.tables.suffixed else ""))

    def _pieces(self, text: str) -> Iterable[tuple[int, ...]]:
        if not text.isascii():
            if not KNOWN.issuperset(text) and any(unicodedata.category(c) == "Cn" for c in text):
                return self._library_pieces(text)  # newer or no Unicode: the library's own tables decide
            if self.lowers:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return map(self.piece_ids.__getitem__, self.pieces_of(text.lower() if self.lowers else text))

    def _library_pieces(self, text: str) -> Iterable[tuple[int, ...]]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        end = END if self.tables.suffixed else ""
        return [self.tables.encode_form(form + end) for form, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if self.lowers and chunk.isascii():  # a word, or a word and a mark: what the pattern would find
            if chunk.isalpha():
                return self.piece_ids[chunk.lower()]
            word, mark = chunk[:-1], chunk[-1]
            if mark in ".,;:!?" and word.isalpha():
                return self.piece_ids[word.lower()] + self.piece_ids[mark]
        if self.special_split is None or "<|" not in chunk:
            return tuple(chain.from_iterable(self._pieces(chunk)))
        ids: list[int] = []
        for part in self.special_split.split(chunk):
            if part in self.tables.specials:
                ids.append(self.tables.specials[part])
            elif part:
                ids.extend(chain.from_iterable(self._pieces(part)))
        return tuple(ids)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that encode on their own."""
        if self.lowers:  # no piece holds white space
            return text.split() if SEPARATORS.search(text) is None else [x for x in ENGINE_SPACE.split(text) if x]
        return spaced_chunks(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.chunk_ids.__getitem__, self.chunks(text)))) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes when the file names no decoder: the tokens' strings, joined by one space."""
        if self.spec_decoder is not None:
            return byte_decode(b"".join(map(self.slices.__getitem__, ids)).decode(), self.letters)
        return b" ".join(map(self.slices.__getitem__, ids)).decode()

    @property
    def spec_decoder(self):
        return self.tables.spec.get("decoder")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        ids = self.encode(text)
        return len(ids), hashlib.sha256(b" ".join(map(self.decimals.__getitem__, ids))).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


#: A space beside other white space, or white space other than space and line feed: the pattern then reads the whole text.
ODD_SPACE = regex.compile(r"[^\S \n]| [ \n]|\n ")


def spaced_chunks(text: str) -> list[str]:
    """Cut before each single space between two non-spaces; a piece of the byte-level pattern never crosses such a cut."""
    if "  " in text or " \n" in text or "\n " in text or ODD_SPACE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def byte_decode(string: str, letters: list[str]) -> str:
    back = {c: b for b, c in enumerate(letters)}
    return bytes(back[c] for c in string).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """One codec for each vocabulary and worker process."""
    return BpeCodec(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ``ids`` (array<int>), one row for each row of ``df``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            ids = [own.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kept = df.select(F.col(id_col), F.col(text_col))
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns ``id_col`` and ``text``: the decoded text of each row's ids (null ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [own.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kept = df.select(F.col(id_col), F.col(ids_col))
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")


def bpe_round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids that ``bpe_encode`` and the texts that ``bpe_decode`` give.

    Both run on the executor that read the text, so that neither ids nor decoded texts are sent anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            rows = [own.digests(x) for x in b.column(1).to_pylist()]
            n, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
