"""Constants and parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass

#: The scale of replayed event time, the start of the observed period, the topic labels in order of their ids.
TIME_SCALE = 50_000
AN_HOUR_SCALED_MS = 72
A_DAY_SCALED_MS = 1_728
AN_HOUR_MS = 3_600_000
A_DAY_MS = 86_400_000
START_MS = 1_421_280_000_000
TOPICS = ("politics", "business", "health", "technology", "entertainment", "sports")

#: Common English function words, the default of every ``stop_words`` parameter; `sources.readers.stop_words` reads another list.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should "
    "so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would "
    "you your".split()
)


@dataclass(frozen=True)
class Smoothing:
    """How counts become log probabilities.

    vocabulary: add the dictionary's size to the denominator once per ``add`` (else once
    only); prior: by documents, by words, or none; seen_only: terms that a label never saw
    are skipped instead of smoothed.
    """

    add: float = 1.0
    vocabulary: bool = True
    prior: str | None = "documents"
    seen_only: bool = False


MULTINOMIAL = Smoothing()
WORD_RATIO = Smoothing(vocabulary=False, prior="words")
STREAM_RATIO = Smoothing(add=0.1, vocabulary=False, prior=None)
STREAM_RATIO_SEEN = Smoothing(add=0.1, vocabulary=False, prior=None, seen_only=True)


@dataclass(frozen=True)
class Periodic:
    """Retrain on the last ``window`` rows before row ``first`` and every ``every`` rows after it."""

    initial: int = 600
    first: int = 1601
    every: int = 1000
    window: int = 600
    reset: bool = False


@dataclass(frozen=True)
class ErrorTriggered:
    """Retrain on the last ``window`` rows when accuracy since the last update falls below ``threshold``."""

    initial: int = 600
    window: int = 600
    threshold: float = 0.63
    sanity: int = 300
    enabled: bool = True


@dataclass(frozen=True)
class Incremental:
    """Refit every ``every`` rows; earlier rows decay by the learning rate (decay: "current" or "compound")."""

    initial: int = 500
    every: int = 50
    low_accuracy: float = 60.0
    step: float = 0.01
    start: float = 1 / 32
    decay: str = "current"
