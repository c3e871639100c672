"""Token ids of whole texts, by a public vocabulary file of the ``tokenizers`` library.

A text is cut at ASCII blanks.  The vocabulary's rules never join what stands on both
sides of white space, nor a letter and the marks behind it, so the ids of a text are the
ids of its pieces in a row, and pieces repeat: each worker keeps the ids of those it has
met.  New words go to the library together, as one text, and are told apart by the tokens
that end a word; other new pieces by a word of one token that stands between them.  Words of
a to z alone, most of what is new, go straight to the merges of the library.  The memory has two generations, the older of which is dropped when the
younger is full: that costs time and never changes an id.  Texts that hold the string of a
special token, or letters whose lower case or normal form is not plain, take slower ways.
"""

import functools
import re

import numpy as np

# Characters that no normal form changes and whose lower case is one character.
NOT_PLAIN = re.compile("[^\x00-\x7f\xa1-\xff\u2010-\u2027]")
# The first mark comes before the look behind, so that the search skips to marks.
MARKS_BEHIND = re.compile("[.,;:!?*#$%&|](?<=[a-z\xdf-\xf6\xf8-\xff].)[.,;:!?*#$%&|]*(?= |$)")
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
PLAIN_WORD = re.compile("[a-z]+").fullmatch   # one word by every rule, and its bytes stand for themselves
PROBES = ("a", "word", "international", "zqxjkvwy", "unbelievableness", "aaaaaaaaaaaa", "naturellement", "theofand")
WORDS_KEPT = 500_000
END_OF_WORD = "</w>"


class Kept:
    """A dictionary of bounded size: two generations of ``most`` entries."""

    def __init__(self, most):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.young[key] = found
        return found

    def update(self, pairs):
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(pairs)


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.folds = self._folds()
        self.between, self.between_id = self._single(vocabulary)
        self.model = self.tokenizer.model
        self.raw = [i.tobytes() for i in np.arange(len(self.ends), dtype="<u4")]
        self.direct = self.folds and all(self._model_ids(w) == self._library([w])[0] for w in PROBES)
        self.words = Kept(WORDS_KEPT)

    def _single(self, vocabulary):
        """A long word that is one token, and its id; None if there is none."""
        longest = sorted((t for t in vocabulary if re.fullmatch("[a-z]{8,}" + END_OF_WORD, t)), key=lambda t: (-len(t), t))
        for token in longest[:100]:
            word = token.removesuffix(END_OF_WORD)
            if self._ids(word) == [vocabulary[token]]:
                return word, vocabulary[token]
        return None, None

    def _ids(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _folds(self):
        """Whether letters are lower-cased, words end in a token of their own, and a word
        and the marks behind it are always encoded apart."""
        return (self._ids("Word") == self._ids("word") and self._ids("a.") == self._ids("a") + self._ids(".")
                and bool(self.ends[self._ids("word")[-1]]))

    def _library(self, pieces):
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _model_ids(self, word):
        """Ids of a word by the merges alone, without the rules that cut a text into words."""
        return b"".join([self.raw[t.id] for t in self.model.tokenize(word)])

    def _joined(self, text):
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _plain_words(self, words):
        """Ids of words of letters only, from one call."""
        ids = self._joined(" ".join(words))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._library(words)
        raw, at, out = ids.tobytes(), 0, []
        for end in (ends * 4).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def _any_pieces(self, pieces):
        """Ids of any pieces, from one call.  As many separators as were put in: no piece holds one."""
        if self.between is None or len(pieces) < 2:
            return self._library(pieces)
        ids = self._joined(f" {self.between} ".join(pieces))
        cuts = np.flatnonzero(ids == self.between_id)
        if len(cuts) != len(pieces) - 1:
            return self._library(pieces)
        raw, at, out = ids.tobytes(), 0, []
        for cut in (cuts * 4).tolist():
            out.append(raw[at:cut])
            at = cut + 4
        out.append(raw[at:])
        return out

    def _learn(self, missing):
        """Ids of pieces that are not among the young ones; keeps them."""
        known, new, words, others = {}, {}, [], []
        for piece in missing:
            ids = self.words.get(piece)
            if ids is not None:
                known[piece] = ids
            elif self.direct and PLAIN_WORD(piece):
                known[piece] = new[piece] = self._model_ids(piece)
            elif self.folds and LETTERS.fullmatch(piece):
                words.append(piece)
            else:
                others.append(piece)
        if words:
            new.update(zip(words, self._plain_words(words)))
        if others:
            new.update(zip(others, self._any_pieces(others)))
        self.words.update(new)
        known.update(new)
        return known

    def encode(self, text):
        """Bytes of the ids of one text; a null text has none."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._library([text])[0]
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if self.folds and not NOT_PLAIN.search(text):
            text = MARKS_BEHIND.sub(r" \g<0>", text.lower())
        pieces = text.split(" ")
        found = list(map(self.words.young.get, pieces))
        try:
            return b"".join(found)
        except TypeError:   # some pieces are not among the young ones
            missing = [i for i, f in enumerate(found) if f is None]
            learnt = self._learn(dict.fromkeys(pieces[i] for i in missing))
            for i in missing:
                found[i] = learnt[pieces[i]]
            return b"".join(found)


@functools.lru_cache(maxsize=2)
def encoder_for(path):
    """The encoder of this worker process: tasks that follow each other share what it has met."""
    return ChunkEncoder(path)


def default_vocabulary():
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
