"""Lexicon sentiment as expressions over a word array. No shuffle: a review is scored within its row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.lookup import let, lookup, one_of


_MARK = "".join(f"\\x{{{ord(c):x}}}" for c in vocab.PUNCTUATION)
_BARE = f"([^ {_MARK}][^ ]+[^ {_MARK}])"
EDGED_WORD = f"(?<![^ ])(?:[{_MARK}]+{_BARE}[{_MARK}]*|{_BARE}[{_MARK}]+)(?![^ ])"


def bare_words(text: Column) -> Column:
    """Lower-case words without surrounding punctuation; words that would shrink to two characters (emoticons)
    stay whole. The whole text is trimmed by one pattern, which is cheaper than looking at every word.
    """
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), EDGED_WORD, "$1$2"), " ")


def compound_label(compound: Column) -> Column:
    return (F.when(compound >= vocab.POSITIVE_FROM, "positive")
            .when(compound <= vocab.NEGATIVE_TO, "negative")
            .otherwise("neutral"))


def normalize_compound(total: Column) -> Column:
    """Map a valence sum to [-1, 1]."""
    return F.bround(total / F.sqrt(total * total + F.lit(vocab.NORMALIZER)), 4)


def tidy_sum(total: Column) -> Column:
    """A sum of one-decimal valences without floating-point dust, so that its sign can be trusted."""
    return F.bround(total, 9)


def valence_sum(lower_words: Column, valences: Mapping[str, float]) -> Column:
    """Sum of word valences, regardless of context."""
    hits = F.filter(lower_words, lambda w: one_of(w, valences))
    return tidy_sum(F.aggregate(hits, F.lit(0.0), lambda total, w: total + lookup(w, valences, "double")))


def is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def boosted(value: Column, boost: Column, damping: Column, shouted: Column) -> Column:
    """`value` after an intensifier of strength `boost`, that stands some words before and may be in capitals."""
    return value + F.signum(value) * damping * (boost + F.when(shouted, F.lit(vocab.CAPS_BOOST)).otherwise(F.lit(0.0)))


def negates(word: Column) -> Column:
    return one_of(word, vocab.NEGATIONS) | word.contains("n't")


def but_weight(position: Column, but_at: Column) -> Column:
    """Weight of the word at `position` (from 0) when the first "but" is word `but_at` (from 1; 0: none)."""
    return (F.when((but_at > 0) & (position + 1 < but_at), F.lit(vocab.BEFORE_BUT))
            .when((but_at > 0) & (position + 1 > but_at), F.lit(vocab.AFTER_BUT)).otherwise(F.lit(1.0)))


def context_valence_sum(words: Column, cased_words: Column, mixed: Column, but_at: Column, valences: Mapping[str, float]) -> Column:
    """Sum of word valences after the context rules: capitals, intensifiers and negation among the three words
    before, and the weight shift at the first "but".

    `words` come from `bare_words`, `cased_words` are the same words as written; `mixed` tells whether any is not in capitals.
    """
    def shouted(position: Column) -> Column:
        # Capitals only count when some other word is not in capitals.
        return mixed & is_upper(F.get(cased_words, position))

    modifiers = [*vocab.BOOSTERS, *vocab.NEGATIONS]

    def look_back(position: Column):
        def step(value: Column, distance: Column) -> Column:
            damping = F.element_at(F.expr(f"array({', '.join(f'{d}D' for d in vocab.BOOST_DAMPING)})"), distance)

            def effect(before: Column) -> Column:
                raised = let(lookup(before, vocab.BOOSTERS, "double"), lambda boost: F.when(
                    boost.isNotNull(), boosted(value, boost, damping, shouted(position - distance))).otherwise(value))
                scaled = raised * F.when(negates(before), F.lit(vocab.NEGATION_SCALE)).otherwise(F.lit(1.0))
                # Most words change nothing, so that is asked first. A word with a valence of its own never does.
                changes = (one_of(before, modifiers) | before.contains("n't")) & ~one_of(before, valences)
                return F.when(changes, scaled).otherwise(value)
            return let(F.get(words, position - distance), effect)
        return step

    def contribution(position: Column) -> Column:
        base = lookup(F.get(words, position), valences, "double")
        start = let(base, lambda v: v + F.when(shouted(position), F.signum(v) * vocab.CAPS_BOOST).otherwise(F.lit(0.0)))
        value = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, look_back(position))
        return value * but_weight(position, but_at)

    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: one_of(F.get(words, i), valences))
    return tidy_sum(F.aggregate(hits, F.lit(0.0), lambda total, i: total + contribution(i)))


def punctuation_emphasis(light: Column) -> Column:
    """Weight of "!" (up to four) and of repeated "?"."""
    def count(mark: str) -> Column:
        return F.length(light) - F.length(F.replace(light, F.lit(mark), F.lit("")))
    questions = count("?")
    return (F.least(count("!"), F.lit(vocab.EXCLAMATION_MAX)) * F.lit(vocab.EXCLAMATION_STEP)
            + F.when(questions <= 1, F.lit(0.0))
            .when(questions <= vocab.QUESTION_MANY, questions * F.lit(vocab.QUESTION_STEP))
            .otherwise(F.lit(vocab.QUESTION_CAP)))


def lexicon_compound(light: Column, valences: Mapping[str, float], context: bool = True) -> Column:
    """Compound score of a cleaned text in [-1, 1]; 0.0 for blank and null."""
    def plain(text: Column) -> Column:
        return valence_sum(bare_words(text), valences)

    def in_context(text: Column) -> Column:
        total = let(bare_words(text), lambda words: let(F.split(text, " "), lambda cased: let(
            F.exists(cased, lambda w: ~is_upper(w)), lambda mixed: let(
                F.array_position(words, "but"), lambda but_at: context_valence_sum(words, cased, mixed, but_at, valences)))))
        return let(total, lambda t: t + F.signum(t) * punctuation_emphasis(text))
    total = let(F.coalesce(light, F.lit("")), in_context if context else plain)
    return let(total, normalize_compound)


def model_label(label: Column) -> Column:
    """Lower-case label name; the numbered names some models emit become words."""
    lower = F.lower(label)
    return lookup(lower, vocab.MODEL_LABELS, "string", default=lower)
