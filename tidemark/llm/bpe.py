"""BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

The distinct words of a chunk of texts are put into a trie, kept in its compact form: the
words in order together with the length of the prefix each shares with the one before. The
trie is walked depth first. A node's state is the last token of the encoding of its prefix;
it is found once from the states above it and serves all words below it. A token ``t`` that
ends a prefix is the last token exactly if the prefix without ``t`` ends in a token that can
stand before ``t``; whether two tokens can stand side by side is read from the merge table by
undoing merges at their boundary in reverse order. Walking the states back from a word's end
gives its encoding.

The last symbol of a word carries the vocabulary's end-of-word suffix and is a symbol of its
own, so it is always the last edge of a word's path.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: White space as Unicode defines it.
WHITE_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Fixed values of the vocabulary's word splitter, with the white space spelled out.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
BLANK = regex.compile(f"[{WHITE_SPACE}]")


_OLD = set(map(chr, range(0x220)))


def has_recent(text: str) -> bool:
    """Whether a text has characters that Unicode 3.2 didn't: what they are depends on a
    library's version. Characters once found to be old are remembered."""
    for c in set(text) - _OLD:
        if unicodedata.ucd_3_2_0.category(c) == "Cn":
            return True
        _OLD.add(c)
    return False


#: Characters of text handled at once: of several short texts, or of a piece of a long one.
CHUNK = 2_000_000
#: Words whose encodings a worker remembers in each of two generations.
REMEMBERED = 150_000
#: Documents whose results are held before they are sent on.
ROWS = 2_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file of kind BPE with an end-of-word suffix."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.strings, -1)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = self.ids[a + b]
            if made in self.parts:
                raise ValueError(f"two merges make the token {a + b!r}; last-token states need one")
            self.parts[made] = (self.ids[a], self.ids[b])
            self.merged[self.ids[a], self.ids[b]] = made
            self.rank[made] = rank
        self.inner = {s: i for s, i in self.ids.items() if not s.endswith(self.suffix)}
        self.final = {s[: -len(self.suffix)]: i for s, i in self.ids.items() if s.endswith(self.suffix)}
        self.inner_lengths, self.final_lengths = self._lengths(self.inner), self._lengths(self.final)
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._symbols = byte_symbols()
        self._bytes = {c: b for b, c in enumerate(self._symbols)}
        self._library = Tokenizer.from_str(definition)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _lengths(tokens: dict[str, int]) -> dict[str, list[int]]:
        """Lengths, longest first, of the tokens that may end a text with the given last three
        symbols, or last two where no longer token ends so."""
        found = {t: {2, 1} for t in tokens if len(t) == 2}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], {2, 1} if t[-2:] in tokens else {1}).add(len(t))
        return {end: sorted(n, reverse=True) for end, n in found.items()}

    def _stay_apart(self, left: int, right: int, bound: int) -> bool:
        """No merge across the boundary comes before the merges that made the two sides."""
        rank, parts = self.rank, self.parts
        while True:
            made = self.merged.get((left, right))
            if made is not None and rank[made] < bound:
                return False
            if rank[left] > rank[right]:
                bound = rank[left]
                left = parts[left][1]
            elif rank[right] >= 0:
                bound = rank[right] + 1  # of equal merges the one further left comes first
                right = parts[right][0]
            else:
                return True

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may come straight after ``left`` in an encoding."""
        key = (left, right)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            found = self._apart[key] = self._stay_apart(left, right, len(self.merged) + 1)
        return found

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        found = self._whole.get(token)
        if found is None:
            if token in self.parts:
                a, b = self.parts[token]
                found = self.whole(a) and self.whole(b) and self._stay_apart(a, b, self.rank[token])
            else:
                found = True
            self._whole[token] = found
        return found

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its token ids, by a depth-first walk over the trie."""
        symbols = self._symbols
        spelled = sorted(("".join([symbols[b] for b in w.encode("utf-8", "surrogatepass")]), w) for w in words)
        inner, final, follows, whole = self.inner, self.final, self.follows, self.whole
        inner_lengths, final_lengths, single = self.inner_lengths.get, self.final_lengths.get, [1]
        last: list[int] = [0]  # last token of each prefix on the path, by depth
        size: list[int] = [0]
        path = ""
        for text, word in spelled:
            end = len(text) - 1
            shared, most = 0, min(len(path), end)
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for depth in range(shared + 1, end + 1):
                for n in depth > 2 and inner_lengths(text[depth - 3 : depth]) or depth > 1 and inner_lengths(text[depth - 2 : depth]) or single:
                    if n > depth:
                        continue
                    t = inner.get(text[depth - n : depth])
                    if t is not None and (n == depth or follows(last[depth - n], t)) and whole(t):
                        last.append(t)
                        size.append(n)
                        break
                else:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
            path = text[:end]
            for n in end > 1 and final_lengths(text[-3:]) or end and final_lengths(text[-2:]) or single:
                if n > end + 1:
                    continue
                t = final.get(text[end + 1 - n :])
                if t is not None and (n == end + 1 or follows(last[end + 1 - n], t)) and whole(t):
                    break
            else:
                raise ValueError(f"the vocabulary can't spell {word!r}")
            ids, at = [t], end + 1 - n
            while at > 0:
                ids.append(last[at])
                at -= size[at]
            yield word, ids[::-1]

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        out: list[str] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                out.append(part)
            elif part and not part.isascii() and has_recent(part):
                # the library's own tables say what its splitter makes of these characters
                library = self._library
                for shown, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                    out.append(bytes(map(self._bytes.__getitem__, shown)).decode("utf-8", "surrogatepass"))
            elif part:
                # lower case is taken character by character: no final form of sigma
                out += WORDS.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out


def pieces(text: str, most: int = CHUNK) -> Iterator[str]:
    """A long text in pieces cut before white space, where no word goes on."""
    at = 0
    while len(text) - at > most:
        cut = BLANK.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Encodings of words, remembered in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.young = self._special()
        self.old: dict[str, tuple[str, str, bytes]] = {}

    def _special(self) -> dict[str, tuple[str, str, bytes]]:
        return {s: (str(i), s, i.to_bytes(4, "little")) for s, i in self.vocabulary.special.items()}

    def learn(self, words: set[str]) -> dict[str, tuple[str, str, bytes]]:
        """Ids and token strings, each joined by blanks, and ids of 4 bytes of at least these words."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, self._special()
        young, old, strings = self.young, self.old, self.vocabulary.strings
        new = words.difference(young)
        known = {w: old[w] for w in new if w in old}
        young.update(known)
        for w, ids in self.vocabulary.encode_words(new.difference(known)):
            young[w] = (" ".join(map(str, ids)), " ".join([strings[i] for i in ids]), b"".join([i.to_bytes(4, "little") for i in ids]))
        return young

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str, bytes]]:
        """For each piece of each text in turn: the text's index, its ids, tokens and packed ids."""
        waiting, room = [], CHUNK
        for i, text in enumerate(texts):
            for piece in pieces(text or ""):
                waiting.append((i, self.vocabulary.split(piece)))
                room -= len(piece)
                if room <= 0:
                    yield from self._joined(waiting)
                    waiting, room = [], CHUNK
        yield from self._joined(waiting)

    def _joined(self, waiting):
        table = self.learn(set().union(*[w for _, w in waiting]))
        for i, words in waiting:
            pairs = list(map(table.__getitem__, words))
            yield i, " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs]), b"".join([p[2] for p in pairs])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(definition) -> Encoder:
    """One encoder for a worker and vocabulary; it lasts over tasks of the same worker."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(definition))
    return _ENCODERS[key]


class _Text:
    """Collects a text's pieces; digests are fed as they come."""

    def __init__(self, keep_ids: bool, keep_text: bool):
        self.n, self.ids, self.parts = 0, [] if keep_ids else None, [] if keep_text else None
        self.ids_sum, self.text_sum = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: str, tokens: str, packed: bytes) -> None:
        if not ids:
            return
        gap = " " if self.n else ""
        self.n += len(packed) // 4
        self.ids_sum.update((gap + ids).encode())
        self.text_sum.update((gap + tokens).encode())
        if self.ids is not None:
            self.ids.append(np.frombuffer(packed, dtype="<i4"))
        if self.parts is not None:
            self.parts.append(gap + tokens)


TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_documents(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``doc_id`` and the asked-for ``outputs`` for every row of ``docs``.

    ``ids`` are the token ids of the whole text without added tokens, ``decoded`` is what they
    decode to with special tokens kept (token strings joined by one blank, as a vocabulary
    file without a decoder gives), ``*_sha256`` their lower-case hexadecimal digests (of the
    decimal ids joined by one blank, and of the decoded text in UTF-8).

    A null text counts as empty: no tokens. A null doc_id and repeated rows are returned as
    they are; a text of any length is encoded in pieces; an empty table gives an empty result;
    other columns are not read. ``tokenizer_json`` names a file that the driver reads; its
    content, a few megabytes, travels as a broadcast variable.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoder(definition.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column("text").to_pylist()
            done: list[_Text] = []
            values: dict[str, list] = {c: [] for c in outputs}

            def close(x):
                found = {"n_tokens": x.n, "ids": x.ids and np.concatenate(x.ids), "decoded": None if x.parts is None else "".join(x.parts), "ids_sha256": x.ids_sum.hexdigest(), "decoded_sha256": x.text_sum.hexdigest()}
                for c in outputs:
                    values[c].append(found[c])

            for i, ids, tokens, packed in encoder.encode(texts):
                if len(done) <= i:
                    if done:
                        close(done[-1])
                        done[-1] = None
                    done.append(_Text("ids" in outputs, "decoded" in outputs))
                done[i].add(ids, tokens, packed)
            if done:
                close(done[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(values[c], type=ARROW[c]) for c in outputs]], names=["doc_id", *outputs])

    return kept.mapInArrow(run, ", ".join([f"doc_id {id_type}", *[f"{c} {TYPES[c]}" for c in outputs]]))
