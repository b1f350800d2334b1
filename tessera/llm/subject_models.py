"""Interpolated n-gram models of subject areas and the decision by cross-entropy."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Weights of the bigram, unigram and background part of a model, and what is added to counts.
BIGRAM, UNIGRAM, ADDED = 0.35, 0.55, 0.5
#: A word bears a subject if its model gives it this many times the background's probability; no
#: word is worth more nats than MOST, and a subject needs LEAST of them.
BEARS, MOST, LEAST = 2.0, 2.0, 1.8
WORDS = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[^\W\d_a-zA-ZÀ-ÿ]+")
#: Sequences that a text has that was read as Latin-1 though it was UTF-8.
MOJIBAKE = re.compile(r"[Â-Ã][\u0080-¿‐-™Œ-ƒˆ˜]")


def words(text: str) -> list[str]:
    """Lower-case words, identifiers split at their humps and underscores, entities decoded."""
    if "&" in text:
        text = html.unescape(text)
    if MOJIBAKE.search(text):
        try:
            text = text.encode("cp1252").decode()
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return [w.lower() for w in WORDS.findall(text.replace("­", "").replace("​", ""))]


def counts(docs: list[list[str]]) -> Counter:
    """Counts of words and of pairs of neighbouring words."""
    out: Counter = Counter()
    for d in docs:
        out.update(d)
        out.update(zip(d, d[1:]))
    return out


@dataclass
class Models:
    """Log ratios of each subject's model to the background's, by word and by pair of words."""

    subjects: list[str]
    one: dict[str, np.ndarray]
    two: dict[tuple[str, str], np.ndarray]
    share: float = 0.26
    density: float = 0.13

    @classmethod
    def fit(cls, subjects: list[str], per_subject: list[Counter], background: Counter, total: int) -> Models:
        if not per_subject:
            return cls(subjects, {}, {})
        table = lambda keys: np.array([[c.get(k, 0) for c in per_subject] for k in keys], float).reshape(len(keys), len(per_subject))
        words_ = list({w: None for c in per_subject for w in c if isinstance(w, str)})
        seen = table(words_)
        n = np.maximum(seen.sum(0), 1)
        v = len(words_) + 1
        bg = (np.array([background.get(w, 0) for w in words_], float) + ADDED) / (total + ADDED * v)
        own = np.where(seen >= 2, seen, 0) / n
        rest = 1 - UNIGRAM - BIGRAM
        one = np.log(((UNIGRAM + BIGRAM) * own + rest * bg[:, None]) / bg[:, None])
        place = {w: i for i, w in enumerate(words_)}
        summed: Counter = Counter()
        for c in per_subject:
            summed.update({k: x for k, x in c.items() if not isinstance(k, str)})
        pairs = [k for k, x in summed.items() if x >= 2]
        first, second = (np.array([place[k[i]] for k in pairs], int) for i in (0, 1))
        given = table(pairs) / np.maximum(seen[first], 1)
        behind = np.array([background.get(k, 0) / max(background.get(k[0], 0), 1) for k in pairs])
        p = BIGRAM * given + UNIGRAM * own[second] + rest * bg[second][:, None]
        q = BIGRAM * behind + (1 - BIGRAM) * bg[second]
        return cls(subjects, dict(zip(words_, one)), dict(zip(pairs, np.log(p / q[:, None]))))

    def gains(self, doc: list[str]) -> np.ndarray:
        """By how many nats each subject's model lowers the cross-entropy of a document's words.

        A word's cross-entropy under a subject's model, given the word before, is compared with
        that under the background's. It counts for the subject that lowers it most, if by log
        ``BEARS`` or more: what is about several subjects has words of each.
        """
        gained = [0.0] * len(self.subjects)
        one, two = self._best()
        last = None
        for w in doc:
            r = two.get((last, w), 0)
            if r == 0:
                r = one.get(w)
            last = w
            if r:
                gained[r[0]] += r[1]
        return np.array(gained)

    def _best(self) -> tuple[dict, dict]:
        """Of each word and pair the subject that saves most and how much, or None if that is too little."""
        found = self.__dict__.get("_found")
        if found is None:
            need = math.log(BEARS)

            def told(table: dict) -> dict:
                if not table:
                    return {}
                r = np.array(list(table.values()))
                best, most = r.argmax(1).tolist(), r.max(1).tolist()
                return {w: (s, min(m, MOST)) if m >= need else None for w, s, m in zip(table, best, most)}

            found = self._found = (told(self.one), told(self.two))
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_found"}

    def _accepted(self, gained: np.ndarray, length: np.ndarray, share: float, density: float) -> np.ndarray:
        """Subjects with a share of all nats gained, of documents that gain enough for their length."""
        total = gained.sum(axis=1, keepdims=True)
        return (gained >= LEAST) & (gained >= share * total) & (total >= density * length[:, None])

    def accept(self, gained: np.ndarray, length: int) -> list[str]:
        good = self._accepted(gained[None, :], np.array([length]), self.share, self.density)[0]
        return [s for s, g in zip(self.subjects, good) if g]

    def calibrate(self, docs: list[list[str]], labels: list[set[str]]) -> float:
        """Choose share and density that fit the labels best (F1 over document and subject).

        The documents should not be those the models were fitted on. All of them have a label, so
        they cannot show what none looks like; the least density tried keeps mentions out.
        """
        if not docs:
            return 0.0
        gained = np.array([self.gains(d) for d in docs])
        length = np.array([len(d) for d in docs])
        truth = np.array([[s in t for s in self.subjects] for t in labels])
        best = (-1.0, self.share, self.density)
        for share in np.arange(0.12, 0.46, 0.02):
            for density in (0.08, 0.1, 0.13, 0.16, 0.2, 0.25):
                said = self._accepted(gained, length, share, density)
                f = 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())
                if f > best[0] + 1e-9:
                    best = (f, float(share), density)
        _, self.share, self.density = best
        return best[0]
