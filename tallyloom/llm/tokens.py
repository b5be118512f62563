"""Token ids of texts, by the tokenizers library and a vocabulary file.

A text's ids are those of its parts one after another, if it is cut only where a pre-tokenizer cuts
it in any case: at white space, and between a letter and the punctuation after it. A batch of
texts is cut and its distinct parts are found by Arrow; only parts that this worker hasn't met yet
are encoded, many in one call. It keeps the ids of two generations of parts, and lets go of the
older one when the younger has MOST_KEPT parts. Parts and ids stay Arrow arrays, some 35 bytes for
each part. Callers give it a few MB of text at once (see columns.slices), so this bounds what a
worker holds.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .columns import lowered

MOST_KEPT = 1 << 17
TOGETHER, AT_ONCE = 64, 16
NONE_KEPT = pa.RecordBatch.from_pydict({"part": pa.array([], pa.large_string()), "ids": pa.array([], pa.large_binary())})
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER, SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: Stands between parts; texts that have it, or the string of an added token, are encoded as they are.
CUT = "\x01"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes texts with a vocabulary file, without adding special tokens.

    leading_space: the vocabulary is byte-level and has a word's space at the word's start.
    Otherwise white space only parts words.
    """

    def __init__(self, name: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.leading_space = leading_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young = self.old = NONE_KEPT
        if leading_space:
            self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, k in self.tokenizer.get_vocab().items():
                self.bytes[k] = len(token)  # a character for each byte
        else:
            self.between = self.one_by_one([CUT])[0]

    def one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; few texts in a call, as the library holds some hundred bytes for each id until it returns."""
        out = []
        for k in range(0, len(texts), AT_ONCE):
            out += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def bytes_of(self, ids: list[np.ndarray], ends: np.ndarray) -> pa.Array:
        """These ids, one after another, in runs that end there; a run's bytes are a value."""
        offsets = np.concatenate([[0], ends]).astype(np.int64) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.empty(0, self.dtype), *ids]))])

    def encoded(self, parts: pa.Array) -> pa.Array:
        """The ids of each part; parts that can stand side by side are encoded in one text."""
        if self.leading_space:
            fit = pc.match_substring_regex(parts, rf"\A [^{WHITE}]")
        else:
            fit = pc.invert(pc.match_substring(parts, CUT))
        fit = fit.to_numpy(zero_copy_only=False)
        there, rest = np.flatnonzero(fit), np.flatnonzero(~fit)
        side = parts.take(pa.array(there))
        groups = pa.LargeListArray.from_arrays(pa.array(np.append(np.arange(0, len(side), TOGETHER), len(side)), pa.int64()), side)
        ids = self.one_by_one(pc.binary_join(groups, pa.scalar("" if self.leading_space else f" {CUT} ", pa.large_string())).to_pylist())
        if self.leading_space:
            ends = np.cumsum(pc.binary_length(side).to_numpy())
            ends = np.searchsorted(np.cumsum(self.bytes[np.concatenate(ids)]), ends) + 1 if len(side) else ends
        else:
            ids = [x for one in ids for x in (one, self.between[:1])]
            flat = np.concatenate([self.between[:0], *ids])
            cuts = np.flatnonzero(flat == self.between[0])
            ids, ends = [flat[flat != self.between[0]]], cuts - np.arange(len(cuts))
        alone = self.one_by_one(parts.take(pa.array(rest)).to_pylist())
        where = np.empty(len(parts), np.int64)
        where[there], where[rest] = np.arange(len(there)), len(there) + np.arange(len(rest))
        return pa.concat_arrays([self.bytes_of(ids, ends), self.bytes_of(alone, np.cumsum([len(x) for x in alone]))]).take(pa.array(where))

    def of_parts(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """An array of ids, and where in it are those of each of these distinct parts."""
        kept = pa.concat_batches([self.young, self.old])
        where = pc.fill_null(pc.index_in(parts, value_set=kept.column("part")), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(where < 0)
        ids = pa.concat_arrays([kept.column("ids"), self.encoded(parts.take(pa.array(new)))])
        where[new] = len(kept) + np.arange(len(new))
        missing = np.flatnonzero(where >= len(self.young))
        if len(self.young) + len(missing) > MOST_KEPT:
            self.old, self.young = self.young, NONE_KEPT
        missing = missing[:MOST_KEPT]
        self.young = pa.concat_batches([self.young, pa.RecordBatch.from_arrays([parts.take(pa.array(missing)), ids.take(pa.array(where[missing]))], schema=NONE_KEPT.schema)])
        return ids, where

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.leading_space:
            # two runs of white space on both sides of a space may belong together
            odd = pc.match_substring_regex(texts, rf"[{WHITE}] ([{WHITE}]|\z)|{CUT}")
            cut = pc.replace_substring(texts, " ", f"{CUT} ")
            cut = pc.replace_substring_regex(cut, rf"([{LETTER}])([{SIGN}])", rf"\1{CUT}\2")
            cut = pc.replace_substring_regex(cut, rf"([^{WHITE}{CUT}]\n)([^{WHITE}{CUT}])", rf"\1{CUT}\2")
            parts = pc.split_pattern(cut, CUT)
        else:
            odd = pc.match_substring(texts, CUT)
            cut = pc.replace_substring_regex(lowered(texts), rf"([{LETTER}])([{SIGN}])", r"\1 \2")
            parts = pc.ascii_split_whitespace(cut)
        for token in self.added:  # in any case, as parts may be lower-cased
            odd = pc.or_(odd, pc.match_substring(texts, token, ignore_case=True))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        flat = parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        del cut, parts
        ids, where = self.of_parts(flat.dictionary)
        ids = ids.take(pa.array(where[flat.indices.to_numpy()]))
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[ends] // self.dtype.itemsize
        out, lengths = np.frombuffer(ids.buffers()[2] or b"", self.dtype)[at[0] : at[-1]], np.diff(at)
        if len(odd):  # these are encoded as they are
            pieces = np.split(out, np.cumsum(lengths)[:-1])
            for i, whole in zip(odd, self.one_by_one([texts[int(i)].as_py() for i in odd]), strict=True):
                pieces[i], lengths[i] = whole, len(whole)
            out = np.concatenate(pieces)
        return out, lengths


@cache
def encoder(name: str, leading_space: bool) -> Encoder:
    """One for each Python worker."""
    return Encoder(name, leading_space)
