"""Word lists and constants. Every list here can be replaced by an argument of the operator that uses it."""

from __future__ import annotations

import re

# --- Fixed values: aspects and their keywords, in report order -------------------------------------------------
ASPECT_KEYWORDS: dict[str, list[str]] = {
    "delivery": ["delivery", "deliver", "ship", "shipping", "arrive", "late", "track", "tracking", "dispatch",
                 "courier"],
    "price": ["price", "cost", "expensive", "cheap", "value", "overprice", "overpriced", "worth", "money"],
    "quality": ["quality", "material", "build", "durable", "defective", "damage", "damaged", "broken", "break"],
    "support": ["support", "service", "response", "respond", "staff", "helpful", "rude", "refund", "complaint",
                "complain"],
    "packaging": ["packaging", "package", "box", "wrap", "wrapped", "seal", "sealed", "crush", "crushed"],
    "ux": ["app", "website", "ui", "interface", "checkout", "navigation", "navigate", "easy", "confusing", "confuse"],
}

# --- Fixed values: labels, their thresholds and the name variants models emit ---------------------------------
SENTIMENTS = ["positive", "neutral", "negative"]
EVALUATION_LABELS = ["negative", "neutral", "positive"]
POSITIVE_FROM, NEGATIVE_TO = 0.05, -0.05
MODEL_LABELS = {"label_0": "negative", "label_1": "neutral", "label_2": "positive"}
PRIORITIES = {"high": 0, "medium": 1, "low": 2}

# --- Fixed values: strings a CSV reader takes for null (exact match, before trimming) -------------------------
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- Fixed values: column-name keywords per role ---------------------------------------------------------------
TEXT_KEYWORDS, TEXT_PREFERRED = ["review", "text", "comment", "content", "body"], ["review", "text"]
RATING_KEYWORDS = ["rating", "score", "stars", "star"]
DATE_KEYWORDS = ["date", "time"]

# --- Stop words: English function words ------------------------------------------------------------------------
STOP_WORDS = """
a an the this that these those
i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves who whom whose which what one ones
and or but nor so yet if then else because while although though unless until since whether than as
of at by for with about against between into through during before after above below to from up down in out on off
over under again further upon within without across along around behind beside besides beyond toward towards via per
is am are was were be been being have has had having do does did doing will would shall should can could may might
must ought
no not never none neither cannot very too also just only even still ever always often more most much many some any
each every either both all such own same other another few less least rather quite really
here there where when why how now once
""".split()

# --- Lemmas: inflected form -> base form, generated from base words by spelling rules ---------------------------
REGULAR_VERBS = """
arrive deliver ship track dispatch overprice respond complain support package wrap seal crush navigate confuse
damage love hate like work use try need want ask help look return order open close stop start fail disappoint
recommend improve enjoy expect charge install replace resolve receive crash wait answer change fix cancel
contact request offer provide serve treat waste save move turn play watch download update upgrade connect click
""".split()
NOUNS = """
price value material service response refund complaint box website interface app day week month year item product
customer order problem issue review star battery screen button page company delivery courier quality staff package
""".split()
IRREGULAR_FORMS = {
    "break": "broke breaks breaking", "build": "built builds building", "buy": "bought buys buying",
    "come": "came comes coming", "cost": "costs costing", "feel": "felt feels feeling", "find": "found finds finding",
    "freeze": "froze freezes freezing frozen",
    "get": "got gets getting gotten", "give": "gave gives giving given", "go": "went goes going gone",
    "keep": "kept keeps keeping", "know": "knew knows knowing known", "leave": "left leaves leaving",
    "lose": "lost loses losing", "make": "made makes making", "pay": "paid pays paying",
    "send": "sent sends sending", "take": "took takes taking taken", "tell": "told tells telling",
    "think": "thought thinks thinking", "write": "wrote writes writing written", "good": "better best",
    "bad": "worse worst", "easy": "easier easiest", "cheap": "cheaper cheapest",
}


def _verb_forms(base: str) -> list[str]:
    ends_y = re.search(r"[^aeiou]y$", base)
    doubled = re.fullmatch(r"[^aeiou]*[aeiou][^aeiouwxy]", base)
    stem = base + base[-1] if doubled else base
    if base.endswith("e"):
        return [_plural(base), base + "d", base[:-1] + "ing"]
    return [_plural(base), base[:-1] + "ied" if ends_y else stem + "ed", stem + "ing"]


def _plural(base: str) -> str:
    if re.search(r"[^aeiou]y$", base):
        return base[:-1] + "ies"
    return base + ("es" if re.search(r"(s|x|z|ch|sh)$", base) else "s")


def lemma_table() -> dict[str, str]:
    """Inflected form -> base. Aspect keywords stay as they are, since the aspect lexicon lists them itself."""
    table: dict[str, str] = {}
    for noun in NOUNS:
        table[_plural(noun)] = noun
    for verb in REGULAR_VERBS:
        table.update(dict.fromkeys(_verb_forms(verb), verb))
    for base, forms in IRREGULAR_FORMS.items():
        table.update(dict.fromkeys(forms.split(), base))
    kept = {word for words in ASPECT_KEYWORDS.values() for word in words}
    return {form: base for form, base in table.items() if form not in kept and form != base}


LEMMAS = lemma_table()

# --- Sentiment lexicon: own valences on the usual -4..4 scale; any (word, valence) table can replace it ---------
VALENCES: dict[str, float] = {
    word: valence
    for valence, words in {
        3.2: "excellent amazing awesome outstanding love loved loves fantastic perfect wonderful",
        2.8: "great brilliant superb best delighted thrilled flawless",
        2.2: "good happy enjoy enjoyed enjoys impressive beautiful win pleased joy",
        1.8: "nice helpful better friendly recommend recommended satisfied glad fun thanks like liked likes",
        1.4: "easy useful reliable smooth solid durable comfortable quick worth fresh premium",
        0.9: "okay ok fine fair decent",
        -0.9: "late slow expensive problem problems issue issues difficult hard",
        -1.4: "confusing cheap delay delayed overpriced noisy weak complain complaint dirty lack",
        -1.9: "bad poor broken defective damaged rude crushed disappointing disappointed annoying fail failed fails "
              "unresponsive wrong sad angry lost refused",
        -2.3: "awful frustrating frustrated useless worse waste scam broke ugly painful unacceptable",
        -2.8: "terrible horrible hate hated hates worst disgusting dreadful pathetic garbage",
    }.items()
    for word in words.split()
}

# --- Fixed values: published constants of the rule-based scorer (Hutto & Gilbert, 2014) -------------------------
BOOST = 0.293
BOOST_DAMPING = [1.0, 0.95, 0.9]
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MANY, QUESTION_CAP = 0.18, 3, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NORMALIZER = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

BOOSTERS: dict[str, float] = {
    **dict.fromkeys(
        "absolutely amazingly completely considerably decidedly deeply enormously entirely especially exceptionally "
        "extremely fully greatly highly hugely incredibly intensely majorly more most particularly purely quite "
        "really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split(),
        BOOST),
    **dict.fromkeys("almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split(),
                    -BOOST),
}
_AUXILIARIES = "ai are ca could dare did does do had has have is might must need ought sha should was were wo would".split()
NEGATIONS = ("not never none nope nor neither nothing nowhere cannot without rarely seldom despite".split()
             + [a + "nt" for a in _AUXILIARIES] + [a + "n't" for a in _AUXILIARIES])
