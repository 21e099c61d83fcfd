"""The registered questions in SQL, written independently of the Spark code.

Shared steps are common table expressions; each question lists what it needs and gets the rest by dependency.
"""

from __future__ import annotations

from reviewloom import vocab
from reviewloom.operators.strategy import PROMPT_PREFACE, PROMPT_SCHEMA
from suite.views import PHRASES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    def cell(v):
        return _text(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _in(words) -> str:
    return "(" + ", ".join(_text(w) for w in words) + ")"


DOCS = """
  SELECT doc_id AS review_id, concat('docs_', lang) AS dataset_id, concat(phrase, ' ', text) AS review_text,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN CAST(1 + doc_id % 5 AS DOUBLE)
              ELSE CAST(base_rating AS DOUBLE) END AS rating,
         CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'not a date'
              ELSE CAST(CAST('2026-01-01' AS DATE) + CAST(doc_id % 60 AS INT) AS VARCHAR) END AS review_date
  FROM documents JOIN phrases ON tid = doc_id % 16"""
SCALE = """
  SELECT o_orderkey AS review_id, o_orderpriority AS dataset_id, phrase AS review_text,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(1 + o_orderkey % 5 AS DOUBLE)
              ELSE CAST(base_rating AS DOUBLE) END AS rating,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS review_date
  FROM orders JOIN phrases ON tid = o_orderkey % 16"""

_LIGHT = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\S+|www\.\S+', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"""
_PREPARED = r"""trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
_WORDS = r"""CASE WHEN {0} IS NULL THEN NULL ELSE CAST(len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')) AS INT) END"""


def _look_back(k: int) -> str:
    """Value after the word `k` places before has been taken into account."""
    v, damping = f"v{k - 1}", vocab.BOOST_DAMPING[k - 1]
    return f"""(CASE WHEN p{k} IS NULL OR p{k} IN {_in(vocab.VALENCES)} THEN {v}
       ELSE ({v} + coalesce((SELECT boost FROM boosters WHERE word = p{k}) * sign({v})
                + CASE WHEN upper(c{k}) = c{k} AND lower(c{k}) <> c{k} AND mixed THEN {vocab.CAPS_BOOST} ELSE 0 END * sign({v}), 0)
              * {damping}) * CASE WHEN p{k} IN {_in(vocab.NEGATIONS)} OR contains(p{k}, 'n''t') THEN {vocab.NEGATION_SCALE} ELSE 1 END
       END) AS v{k}"""


def _compound(total: str) -> str:
    return f"round_even({total} / sqrt({total} * {total} + {vocab.NORMALIZER}), 4)"


def _label(score: str) -> str:
    return (f"CASE WHEN {score} >= {vocab.POSITIVE_FROM} THEN 'positive' WHEN {score} <= {vocab.NEGATIVE_TO} "
            f"THEN 'negative' ELSE 'neutral' END")


STEPS: dict[str, str] = {
    "phrases": f"phrases(tid, phrase, base_rating) AS ({_values((i, p, r) for i, (p, r) in enumerate(PHRASES))})",
    "lexicon": "lexicon(aspect_ord, aspect, keyword) AS (" + _values(
        (i, a, w) for i, (a, ws) in enumerate(vocab.ASPECT_KEYWORDS.items()) for w in ws) + ")",
    "stops": f"stops(word) AS ({_values((w,) for w in vocab.STOP_WORDS)})",
    "lemmas": f"lemmas(word, lemma) AS ({_values(vocab.LEMMAS.items())})",
    "valences": f"valences(word, valence) AS ({_values((w, float(v)) for w, v in vocab.VALENCES.items())})",
    "boosters": f"boosters(word, boost) AS ({_values((w, float(v)) for w, v in vocab.BOOSTERS.items())})",
    "keyed": "keyed AS (SELECT *, concat(dataset_id, '#', review_id) AS rid FROM reviews)",
    "light": f"light AS (SELECT rid, {_LIGHT.format('review_text')} AS clean_light FROM keyed)",
    "bare": f"""bare AS (
  SELECT rid, pos, CASE WHEN length(t) <= 2 THEN raw ELSE t END AS w FROM (
    SELECT rid, pos, raw, trim(raw, {_text(vocab.PUNCTUATION)}) AS t FROM (
      SELECT rid, unnest(string_split(clean_light, ' ')) AS raw,
             generate_subscripts(string_split(clean_light, ' '), 1) AS pos FROM light)))""",
    "plain_sums": """plain_sums AS (
  SELECT rid, round_even(coalesce(sum(valence), 0), 9) AS total FROM bare LEFT JOIN valences ON lower(w) = word GROUP BY rid)""",
    "around": """around AS (
  SELECT rid, pos, w, lower(w) AS lw, bool_or(NOT (upper(w) = w AND lower(w) <> w)) OVER (PARTITION BY rid) AS mixed,
         min(CASE WHEN lower(w) = 'but' THEN pos END) OVER (PARTITION BY rid) AS but_at,
         lag(w, 1) OVER o AS c1, lag(w, 2) OVER o AS c2, lag(w, 3) OVER o AS c3,
         lower(lag(w, 1) OVER o) AS p1, lower(lag(w, 2) OVER o) AS p2, lower(lag(w, 3) OVER o) AS p3
  FROM bare WINDOW o AS (PARTITION BY rid ORDER BY pos))""",
    "v0": f"""v0 AS (
  SELECT around.*, valence + CASE WHEN upper(w) = w AND lower(w) <> w AND mixed THEN sign(valence) * {vocab.CAPS_BOOST} ELSE 0 END AS v0
  FROM around JOIN valences ON word = lw)""",
    "v1": f"v1 AS (SELECT *, {_look_back(1)} FROM v0)",
    "v2": f"v2 AS (SELECT *, {_look_back(2)} FROM v1)",
    "v3": f"v3 AS (SELECT *, {_look_back(3)} FROM v2)",
    "sums": f"""sums AS (
  SELECT rid, round_even(sum(v3 * CASE WHEN but_at IS NULL OR pos = but_at THEN 1.0 WHEN pos < but_at THEN {vocab.BEFORE_BUT}
                                       ELSE {vocab.AFTER_BUT} END), 9) AS total FROM v3 GROUP BY rid)""",
    "marks": """marks AS (
  SELECT rid, length(clean_light) - length(replace(clean_light, '!', '')) AS bangs,
         length(clean_light) - length(replace(clean_light, '?', '')) AS questions FROM light)""",
    "totals": f"""totals AS (
  SELECT rid, coalesce(total, 0) + sign(coalesce(total, 0)) * (
           least(bangs, {vocab.EXCLAMATION_MAX}) * {vocab.EXCLAMATION_STEP}
           + CASE WHEN questions <= 1 THEN 0 WHEN questions <= {vocab.QUESTION_MANY} THEN questions * {vocab.QUESTION_STEP}
                  ELSE {vocab.QUESTION_CAP} END) AS total
  FROM marks LEFT JOIN sums USING (rid))""",
    "scored": f"scored AS (SELECT rid, compound, {_label('compound')} AS label FROM (SELECT rid, {_compound('CAST(total AS DOUBLE)')} AS compound FROM totals))",
    "plain_scored": f"plain_scored AS (SELECT rid, compound, {_label('compound')} AS label FROM (SELECT rid, {_compound('total')} AS compound FROM plain_sums))",
    "prepared": f"prepared AS (SELECT rid, {_PREPARED.format('review_text')} AS prepared FROM keyed)",
    "kept": """kept AS (
  SELECT rid, pos, coalesce(lemma, word) AS word FROM (
    SELECT rid, unnest(string_split(prepared, ' ')) AS word, generate_subscripts(string_split(prepared, ' '), 1) AS pos
    FROM prepared) AS t LEFT JOIN lemmas USING (word)
  WHERE word <> '' AND word NOT IN (SELECT word FROM stops))""",
    "deep": """deep AS (
  SELECT rid, coalesce(joined, '') AS clean_deep FROM keyed
  LEFT JOIN (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS joined FROM kept GROUP BY rid) USING (rid))""",
    "mentions": "mentions AS (SELECT DISTINCT rid, aspect_ord, aspect FROM kept JOIN lexicon ON word = keyword)",
    "tags": """tags AS (
  SELECT rid, coalesce(joined, '') AS aspects FROM keyed
  LEFT JOIN (SELECT rid, string_agg(aspect, ',' ORDER BY aspect_ord) AS joined FROM mentions GROUP BY rid) USING (rid))""",
    "analyzed": f"""analyzed AS (
  SELECT keyed.*, clean_light, clean_deep, {_WORDS.format('review_text')} AS word_count, label AS sentiment,
         abs(compound) AS confidence, aspects
  FROM keyed JOIN light USING (rid) JOIN deep USING (rid) JOIN scored USING (rid) JOIN tags USING (rid))""",
    "children": """children AS (
  SELECT dataset_id, review_id, aspect, aspect_ord, sentiment, review_text
  FROM mentions JOIN analyzed USING (rid))""",
    "by_aspect": """by_aspect AS (
  SELECT dataset_id, aspect, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive,
         count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative
  FROM children GROUP BY dataset_id, aspect)""",
    "every_aspect": """every_aspect AS (
  SELECT dataset_id, CAST(aspect_ord AS INT) AS aspect_ord, aspect, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive,
         coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative,
         round_even(coalesce(negative / total, 0), 4) AS negative_share,
         round_even(coalesce(positive / total, 0), 4) AS positive_share
  FROM (SELECT DISTINCT dataset_id FROM reviews) CROSS JOIN (SELECT DISTINCT aspect_ord, aspect FROM lexicon)
  LEFT JOIN by_aspect USING (dataset_id, aspect))""",
    "complaints": """complaints AS (
  SELECT * FROM (SELECT dataset_id, aspect, row_number() OVER (PARTITION BY dataset_id ORDER BY negative / total DESC, aspect) AS rank
                 FROM by_aspect) WHERE rank <= 3)""",
    "examples": """examples AS (
  SELECT * FROM (
    SELECT dataset_id, aspect, CAST(row_number() OVER (PARTITION BY dataset_id, aspect ORDER BY review_id) AS INT) AS position,
           review_id, review_text
    FROM children WHERE sentiment = 'negative') WHERE position <= 3)""",
    "snippets": """snippets AS (
  SELECT dataset_id, aspect, position, review_id, substring(review_text, 1, 300) AS snippet
  FROM examples JOIN complaints USING (dataset_id, aspect) WHERE review_text <> '')""",
    "truth": """truth AS (
  SELECT rid, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' WHEN rating IS NOT NULL THEN 'negative' END AS truth
  FROM keyed)""",
    "judged": """judged AS (
  SELECT rid, truth, scored.label AS context_label, plain_scored.label AS plain_label
  FROM truth JOIN scored USING (rid) JOIN plain_scored USING (rid))""",
    "long_judged": """long_judged AS (
  SELECT 'context' AS model, truth, context_label AS said FROM judged WHERE truth IS NOT NULL
  UNION ALL SELECT 'plain', truth, plain_label FROM judged WHERE truth IS NOT NULL)""",
    "labels3": f"labels3(ordinal, label) AS ({_values(enumerate(vocab.EVALUATION_LABELS))})",
    "per_label": """per_label AS (
  SELECT model, ordinal, label, count(*) FILTER (truth = label) AS support, count(*) FILTER (said = label) AS said_n,
         count(*) FILTER (truth = label AND said = label) AS hit
  FROM long_judged CROSS JOIN labels3 GROUP BY model, ordinal, label)""",
    "label_metrics": """label_metrics AS (
  SELECT model, ordinal, label, support, coalesce(hit / nullif(said_n, 0), 0) AS precision,
         coalesce(hit / nullif(support, 0), 0) AS recall,
         coalesce(2 * hit / nullif(said_n + support, 0), 0) AS f1
  FROM per_label)""",
    # Multinomial naive Bayes with add-one smoothing, trained on the rated reviews.
    "tokens": r"""tokens AS (
  SELECT rid, word FROM (SELECT rid, unnest(string_split_regex(lower(clean_light), '[^\p{L}\p{N}_]+')) AS word FROM light) WHERE word <> '')""",
    "class_words": """class_words AS (
  SELECT truth, word, count(*) AS n FROM tokens JOIN truth USING (rid) WHERE truth IS NOT NULL GROUP BY truth, word)""",
    "class_stats": """class_stats AS (
  SELECT truth, docs, words, (SELECT count(DISTINCT word) FROM class_words) AS vocabulary,
         ln(docs + 1) - ln(sum(docs) OVER () + count(*) OVER ()) AS prior
  FROM (SELECT truth, count(*) AS docs FROM truth WHERE truth IS NOT NULL GROUP BY truth)
  JOIN (SELECT truth, sum(n) AS words FROM class_words GROUP BY truth) USING (truth))""",
    "known_tokens": """known_tokens AS (
  SELECT rid, word, count(*) AS tf FROM tokens SEMI JOIN class_words USING (word) GROUP BY rid, word)""",
    "class_sums": """class_sums AS (
  SELECT rid, class_stats.truth, sum(tf * (ln(coalesce(n, 0) + 1) - ln(words + vocabulary))) AS fit
  FROM known_tokens CROSS JOIN class_stats
  LEFT JOIN class_words ON class_words.word = known_tokens.word AND class_words.truth = class_stats.truth
  GROUP BY rid, class_stats.truth)""",
    "class_scores": """class_scores AS (
  SELECT keyed.rid, class_stats.truth, prior + coalesce(fit, 0) AS score
  FROM keyed CROSS JOIN class_stats LEFT JOIN class_sums ON class_sums.rid = keyed.rid AND class_sums.truth = class_stats.truth)""",
    "modelled": """modelled AS (
  SELECT rid, arg_max(truth, score) AS model_label, round_even(1 / sum(exp(score - top)), 4) AS model_confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY rid) AS top FROM class_scores) GROUP BY rid)""",
    # The batch chain compares the context scorer and the trained model.
    "batch_judged": """batch_judged AS (
  SELECT 'lexicon' AS model, truth, label AS said FROM truth JOIN scored USING (rid) WHERE truth IS NOT NULL
  UNION ALL SELECT 'model', truth, model_label FROM truth JOIN modelled USING (rid) WHERE truth IS NOT NULL)""",
    "batch_labels": """batch_labels AS (
  SELECT model, label, support, coalesce(hit / nullif(said_n, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
         coalesce(2 * hit / nullif(said_n + support, 0), 0) AS f1
  FROM (SELECT model, label, count(*) FILTER (truth = label) AS support, count(*) FILTER (said = label) AS said_n,
               count(*) FILTER (truth = label AND said = label) AS hit FROM batch_judged CROSS JOIN labels3 GROUP BY model, label))""",
    "batch_overall": """batch_overall AS (
  SELECT model, any_value(n) AS n, any_value(accuracy) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
         sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted,
         sum(f1 * support) / sum(support) AS f1_weighted
  FROM batch_labels JOIN (SELECT model, count(*) AS n, avg(CAST(truth = said AS INT)) AS accuracy FROM batch_judged GROUP BY model) USING (model)
  GROUP BY model)""",
    # Dates as the datasets write them: French and English ones partly in numbers that can be read in two ways.
    "dated": """dated AS (
  SELECT *, CAST('2016-12-01' AS DATE) + CAST(review_id % 90 AS INT) AS day,
         CASE CAST(review_id % 3 AS INT) WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
         review_id % 13 <> 0 AND dataset_id IN ('docs_de', 'docs_fr', 'docs_es', 'docs_en') AS written,
         dataset_id = 'docs_fr' OR (dataset_id = 'docs_en' AND review_id % 4 < 2) AS two_ways FROM reviews)""",
    # Terms per source, the fixed topic assignment of the keyword questions.
    "terms": r"""terms AS (
  SELECT source, term, count(*) AS tf FROM (
    SELECT source, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS term FROM topic_docs)
  WHERE length(term) >= 2 AND term NOT IN (SELECT word FROM stops) GROUP BY source, term)""",
    "topic_docs": f"topic_docs AS (SELECT source, doc_id, {_LIGHT.format('review_text')} AS text FROM reviews JOIN documents ON doc_id = review_id)",
    "keywords": """keywords AS (
  SELECT * FROM (
    SELECT source, term, tf, weight, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INT) AS position FROM (
      SELECT source, term, tf, round_even(tf * ln(1 + (SELECT sum(tf) / count(DISTINCT source) FROM terms)
                                                     / sum(tf) OVER (PARTITION BY term)), 8) AS weight FROM terms))
  WHERE position <= 10)""",
    "answers": r"""answers AS (
  SELECT doc_id AS answer_id, source AS dataset_id, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
         CASE doc_id % 4 WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 1 THEN body
                         WHEN 2 THEN concat('  ```', chr(10), body) ELSE text END AS answer
  FROM (SELECT *, concat('{"executive_summary": "', source, ' holds ', n_chars, ' characters", "recommendations": [',
          '{"aspect": "delivery", "finding": "f', doc_id, '", "recommendation": "faster", "priority": "low"}, ',
          '{"aspect": "price", "finding": "p', doc_id, '", "recommendation": "cheaper", "priority": "high"}, ',
          '{"aspect": "ux", "finding": "u', doc_id, '", "recommendation": "simpler"}, ',
          '{"aspect": "quality", "finding": "q', doc_id, '", "recommendation": "better", "priority": "urgent"}, ',
          '{"aspect": "support", "finding": "s', doc_id, '", "recommendation": "kinder", "priority": "medium"}]}') AS body
        FROM documents))""",
    "bodies": r"""bodies AS (
  SELECT *, CASE WHEN starts_with(t, '```')
                 THEN trim(regexp_replace(regexp_replace(t, '^```[^\n]*', ''), '(^|\n)\s*```[^\n]*$', ''), E' \n') ELSE t END AS body
  FROM (SELECT *, trim(answer, E' \t\n\r') AS t FROM answers))""",
    "valid": """valid AS (
  SELECT *, json_valid(body) AS ok FROM bodies)""",
    "recommendations": """recommendations AS (
  SELECT answer_id, generate_subscripts(items, 1) AS given, unnest(items) AS item
  FROM (SELECT answer_id, CAST(json_extract(body, '$.recommendations') AS JSON[]) AS items FROM valid WHERE ok))""",
    "raw_reviews": r"""raw_reviews AS (
  SELECT review_id, CASE WHEN review_id % 19 = 0 THEN ' NaN ' WHEN review_id % 23 = 0 THEN E' \t ' WHEN review_id % 29 = 0 THEN NULL
                         WHEN review_id % 31 = 0 THEN 'N/A'
                         ELSE concat(E'\t ', review_text, E' \n') END AS review_text, rating, review_date FROM reviews)""",
    "uploaded": """uploaded AS (
  SELECT CAST(review_id AS VARCHAR) AS "Id", dataset_id AS "Origin", review_text AS "Opinion",
         CAST(rating AS VARCHAR) AS "Stars", review_date AS "Posted_Time" FROM reviews)""",
}

NEEDS: dict[str, str] = {
    "keyed": "reviews", "light": "keyed", "bare": "light", "plain_sums": "bare valences", "around": "bare",
    "v0": "around valences", "v1": "v0 boosters", "v2": "v1", "v3": "v2", "sums": "v3", "marks": "light",
    "totals": "marks sums", "scored": "totals", "plain_scored": "plain_sums", "prepared": "keyed",
    "kept": "prepared lemmas stops", "deep": "kept", "mentions": "kept lexicon", "tags": "mentions",
    "analyzed": "light deep scored tags", "children": "mentions analyzed", "by_aspect": "children",
    "every_aspect": "by_aspect", "complaints": "by_aspect", "examples": "children", "snippets": "examples complaints",
    "truth": "keyed", "judged": "truth scored plain_scored", "long_judged": "judged", "per_label": "long_judged labels3",
    "label_metrics": "per_label", "tokens": "light", "class_words": "tokens truth", "class_stats": "class_words",
    "known_tokens": "tokens class_words", "class_sums": "known_tokens class_stats", "class_scores": "class_sums",
    "modelled": "class_scores", "topic_docs": "reviews", "terms": "topic_docs stops", "keywords": "terms",
    "batch_judged": "truth scored modelled", "batch_labels": "batch_judged labels3", "batch_overall": "batch_labels", "dated": "reviews",
    "bodies": "answers", "valid": "bodies", "recommendations": "valid", "raw_reviews": "reviews", "uploaded": "reviews",
}
SOURCES = {"docs": DOCS, "scale": SCALE, "both": f"{DOCS} UNION ALL {SCALE}"}


def _sql(body: str, needs: str = "", source: str = "docs") -> str:
    ordered: list[str] = []

    def add(step: str) -> None:
        if step in ordered:
            return
        for needed in NEEDS.get(step, "").split():
            add(needed)
        if step == "reviews":
            add("phrases")
        ordered.append(step)

    for step in needs.split():
        add(step)
    # A step used twice is computed once.
    texts = [f"reviews AS MATERIALIZED ({SOURCES[source]})" if s == "reviews" else
             STEPS[s].replace(" AS (", " AS MATERIALIZED (", 1) if not STEPS[s].split(" AS (")[0].endswith(")") else STEPS[s]
             for s in ordered]
    return ("WITH " + ",\n".join(texts) + "\n" if texts else "") + body


FLAGS = ", ".join(f"list_contains(string_split(aspects, ','), '{a}') AS aspect_{a}" for a in vocab.ASPECT_KEYWORDS)
TOP_WORDS = "SELECT word, count(*) AS n FROM kept {0} GROUP BY word ORDER BY n DESC, word LIMIT 20"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources and sinks
    q["load_reviews_csv"] = _sql(r"""SELECT review_id, review_text, rating, review_date FROM (
      SELECT review_id, trim(CASE WHEN review_text = 'N/A' THEN NULL ELSE review_text END, E' \t\n\r\f\v') AS review_text, rating, review_date
      FROM raw_reviews) WHERE review_text <> '' AND lower(review_text) <> 'nan'""", "raw_reviews")
    q["stage_roundtrip"] = _sql("SELECT review_id, clean_light, clean_deep, word_count FROM analyzed", "analyzed")
    q["load_analysis"] = _sql("""SELECT review_id, review_text, clean_deep, sentiment, confidence, aspects, rating, review_date
      FROM analyzed WHERE dataset_id = 'docs_fr'""", "analyzed", "both")
    q["review_aspects_normalized"] = _sql("SELECT dataset_id, review_id, aspect, sentiment FROM children", "children", "both")
    q["strategy_latest"] = _sql("""SELECT dataset_id, arg_max(answer, created_at) AS strategy_json,
      strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM answers GROUP BY dataset_id""", "answers")
    ranked = {k: f"""SELECT dataset_id, string_agg(aspect, ',' ORDER BY {k}_share DESC, {k} DESC, aspect_ord) AS ranked
      FROM every_aspect WHERE total > 0 GROUP BY dataset_id""" for k in ("negative", "positive")}
    q["aspect_summary_json"] = _sql(f"""SELECT dataset_id, c.ranked AS top_complaints, p.ranked AS top_praise, aspect, total, positive, neutral,
      negative, negative_share, positive_share FROM every_aspect JOIN ({ranked['negative']}) AS c USING (dataset_id)
      JOIN ({ranked['positive']}) AS p USING (dataset_id)""", "every_aspect", "both")
    q["load_reviews_in_file_order"] = _sql("""SELECT line, review_id, rating FROM (
      SELECT row_number() OVER (ORDER BY review_id) - 1 AS line, review_id, rating,
             trim(CASE WHEN review_text = 'N/A' THEN NULL ELSE review_text END, E' \\t\\n\\r\\f\\v') AS review_text FROM raw_reviews)
      WHERE review_text <> '' AND lower(review_text) <> 'nan'""", "raw_reviews")
    overall = {"n": "CAST(n AS DOUBLE)", **{k: k for k in ("accuracy", "precision_macro", "recall_macro", "f1_macro")}}
    report = [("label", k, k) for k in ("precision", "recall", "f1", "support")]
    averages = [(f"{kind} avg", k, f"{k}_{kind}") for kind in ("macro", "weighted") for k in ("precision", "recall", "f1")]
    rows = ["SELECT 'agreement' AS part, '' AS row, 'agreement' AS name, avg(CAST(coalesce(label = model_label, false) AS INT)) AS value FROM scored JOIN modelled USING (rid)"]
    rows += [f"SELECT 'metrics', model, '{k}', {v} FROM batch_overall" for k, v in overall.items()]
    rows += [f"SELECT 'report', concat(model, '/', label), '{k}', {v} FROM batch_labels" for _, k, v in report]
    rows += [f"SELECT 'report', concat(model, '/{line}'), '{k}', {v} FROM batch_overall" for line, k, v in
             [("accuracy", "f1", "accuracy"), *averages, *((line, "support", "n") for line in ("accuracy", "macro avg", "weighted avg"))]]
    rows += [f"SELECT 'confusion_{m}', label, '{said}', count(*) FILTER (truth = label AND said = '{said}' AND model = '{m}') FROM labels3 CROSS JOIN batch_judged GROUP BY label"
             for m in ("lexicon", "model") for said in vocab.EVALUATION_LABELS]
    q["batch_report"] = _sql(f"SELECT part, row, name, round_even(CAST(value AS DOUBLE), 6) AS value FROM ({' UNION ALL '.join(rows)})", "batch_overall")
    modelled_aspects = """(SELECT aspect_ord, aspect, count(mentions.rid) AS total, count(*) FILTER (model_label = 'positive') AS positive,
      count(*) FILTER (model_label = 'neutral') AS neutral, count(*) FILTER (model_label = 'negative') AS negative
      FROM (SELECT DISTINCT aspect_ord, aspect FROM lexicon) LEFT JOIN mentions USING (aspect_ord, aspect) LEFT JOIN modelled USING (rid) GROUP BY ALL)"""
    share = lambda k: f"round_even(coalesce({k} / nullif(total, 0), 0), 4)"
    best = lambda k: f"(SELECT string_agg(aspect, ',' ORDER BY {share(k)} DESC, {k} DESC, aspect_ord) FROM m WHERE total > 0)"
    q["batch_aspects"] = _sql(f"""SELECT {best('negative')} AS top_complaints, {best('positive')} AS top_praise, aspect, total, positive, neutral, negative,
      {share('negative')} AS negative_share, {share('positive')} AS positive_share FROM {modelled_aspects} AS m""".replace("FROM m WHERE", f"FROM {modelled_aspects} WHERE"),
        "mentions modelled")
    q["ingest_upload"] = _sql("""SELECT review_text, clean_deep, sentiment, confidence, aspects, rating, review_date FROM analyzed""", "analyzed")
    # rows
    q["clean_rows"] = _sql(r"""SELECT review_id, review_text FROM (SELECT review_id, trim(review_text, E' \t\n\r\f\v') AS review_text
      FROM raw_reviews) WHERE review_text <> '' AND lower(review_text) <> 'nan'""", "raw_reviews")
    names = ["Id", "Origin", "Opinion", "Stars", "Posted_Time"]
    roles = {"Opinion": ("0, 0, 0", "'text'"), "Stars": ("0, 1, 0", "'rating'"), "Posted_Time": ("0, 0, 1", "'date'")}
    q["column_roles"] = _sql(" UNION ALL ".join(f"""SELECT {i} AS ordinal, '{n}' AS column_name, {s.split(', ')[0]} AS text_score,
      {s.split(', ')[1]} AS rating_score, {s.split(', ')[2]} AS date_score, round_even(avg(length("{n}")), 6) AS mean_length,
      round_even(avg(CAST(TRY_CAST("{n}" AS DOUBLE) IS NOT NULL AS INT)), 6) AS numeric_share,
      round_even(avg(CAST(TRY_CAST("{n}" AS DATE) IS NOT NULL AS INT)), 6) AS date_share, {r} AS role FROM uploaded"""
        for i, n in enumerate(names) for s, r in [roles.get(n, ("0, 0, 0", "CAST(NULL AS VARCHAR)"))]), "uploaded")
    q["profile_text_columns"] = _sql("SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{n}' AS column_name, round_even(avg(length("{n}")), 6) AS mean_length FROM uploaded"""
        for i, n in enumerate(names)) + ") ORDER BY mean_length DESC, ordinal", "uploaded")
    q["column_mapping"] = _sql("""SELECT "Id", "Origin", "Opinion" AS review_text, "Stars" AS rating, "Posted_Time" AS review_date
      FROM uploaded""", "uploaded")
    q["sample_head"] = _sql("SELECT review_id, review_text FROM reviews ORDER BY review_id LIMIT 100", "reviews")
    q["rating_sentiment"] = _sql("SELECT review_id, rating, truth AS rating_sentiment FROM truth JOIN keyed USING (rid)", "truth", "scale")
    q["dataset_exists"] = _sql("""SELECT wanted AS dataset_id, bool_or(dataset_id = wanted) AS found FROM reviews
      CROSS JOIN (VALUES ('docs_en'), ('docs_none'), ('2-HIGH')) AS w(wanted) GROUP BY wanted""", "reviews", "both")
    q["filter_reviews"] = _sql("""SELECT review_text, sentiment, confidence, aspects, rating, review_date FROM analyzed
      WHERE sentiment IN ('negative', 'neutral') AND list_has_any(string_split(aspects, ','), ['delivery', 'ux'])""", "analyzed")
    q["topic_place"] = """WITH parts AS (SELECT label AS topic, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
      centers AS (SELECT topic, list(x ORDER BY pos) AS center FROM (SELECT topic, pos, round_even(avg(x), 9) AS x FROM parts GROUP BY ALL) GROUP BY topic),
      far AS (SELECT vec_id, topic, sqrt(list_sum(list_transform(range(1, len(center) + 1), lambda i: (embedding[i]::DOUBLE - center[i]) * (embedding[i]::DOUBLE - center[i])))) AS d
              FROM embeddings CROSS JOIN centers),
      near AS (SELECT vec_id, arg_min(topic, (d, topic)) AS topic, min(d) AS d FROM far GROUP BY vec_id),
      limits AS (SELECT topic, quantile_disc(d, 0.95) AS most FROM near GROUP BY topic)
      SELECT vec_id, CASE WHEN d > most THEN -1 ELSE topic END AS topic, round_even(d, 6) AS topic_distance FROM near JOIN limits USING (topic)"""
    q["null_counts"] = _sql(" UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM reviews"
        for i, c in enumerate(["review_id", "dataset_id", "review_text", "rating", "review_date"])), "reviews", "both")
    q["duplicate_reviews"] = _sql("SELECT count(*) - count(DISTINCT review_text) AS duplicates FROM reviews", "reviews", "both")
    q["duplicate_review_rows"] = """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy
      FROM documents) WHERE copy > 1"""
    q["unmatched_reviews"] = _sql("SELECT dataset_id, review_id, clean_deep FROM analyzed WHERE aspects = ''", "analyzed", "both")
    q["unmatched_top_words"] = _sql(TOP_WORDS.format("SEMI JOIN (SELECT rid FROM tags WHERE aspects = '') USING (rid)"), "tags", "both")
    fields = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(92) || 'N')" for c in ["review_id", "review_text", "rating", "review_date"])
    q["dataset_fingerprint"] = _sql(f"""SELECT dataset_id, concat('reviews_', substr(md5(concat_ws('|', count(*), bit_xor(h), sum(h))), 1, 10)) AS fingerprint
      FROM (SELECT dataset_id, CAST(concat('0x', substr(md5(concat_ws(chr(31), {fields})), 1, 15)) AS BIGINT) AS h FROM reviews)
      GROUP BY dataset_id""", "reviews", "both")
    # text
    q["nfkc_text"] = "SELECT doc_id, nfc_normalize(text) AS nfkc FROM documents"
    q["clean_light"] = f"SELECT page_id, {_LIGHT.format('html')} AS clean_light FROM pages"
    q["deep_prep"] = f"SELECT page_id, {_PREPARED.format('html')} AS prepared FROM pages"
    q["clean_deep"] = _sql("SELECT review_id, clean_deep FROM deep JOIN keyed USING (rid)", "deep")
    q["clean_deep_tables"] = q["clean_deep"]
    q["word_count"] = f"SELECT conv_id, turn, {_WORDS.format('text')} AS word_count FROM conversations"
    q["preprocess"] = _sql("SELECT review_id, dataset_id, clean_light, clean_deep, word_count FROM analyzed", "analyzed", "scale")
    q["aspects_string_roundtrip"] = _sql("""SELECT review_id, aspects AS joined,
      CAST(CASE WHEN aspects = '' THEN 0 ELSE len(string_split(aspects, ',')) END AS INT) AS n_aspects FROM tags JOIN keyed USING (rid)""", "tags")
    q["strategy_parse"] = _sql("""SELECT answer_id, CASE WHEN ok THEN json_extract_string(body, '$.executive_summary') END AS executive_summary,
      CASE WHEN ok THEN CAST(json_array_length(body, '$.recommendations') AS INT) END AS n_recommendations,
      CASE WHEN NOT ok THEN answer END AS raw FROM valid""", "valid")
    q["normalize_labels"] = """SELECT doc_id, CASE lower(raw) WHEN 'label_0' THEN 'negative' WHEN 'label_1' THEN 'neutral'
      WHEN 'label_2' THEN 'positive' ELSE lower(raw) END AS label
      FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Negative' ELSE concat('LABEL_', quality + doc_id % 2) END AS raw FROM labels)"""
    # sentiment
    q["lexicon_sentiment"] = _sql("SELECT review_id, compound AS vader_score, label AS vader_label FROM plain_scored JOIN keyed USING (rid)", "plain_scored")
    q["lexicon_sentiment_tables"] = q["lexicon_sentiment"]
    q["lexicon_sentiment_context"] = _sql("SELECT dataset_id, review_id, compound AS vader_score, label AS vader_label FROM scored JOIN keyed USING (rid)", "scored", "both")
    q["compound_label"] = f"""SELECT label, count(*) AS n FROM (SELECT {_label('l_discount - 0.05::DOUBLE')} AS label FROM lineitem) GROUP BY label"""
    q["lexicon_sentiment_context_tables"] = q["lexicon_sentiment_context"]
    q["analyze_model"] = _sql(f"""SELECT dataset_id, review_id, clean_light, clean_deep, {_WORDS.format('review_text')} AS word_count, model_label AS sentiment,
      model_confidence AS confidence, aspects, {FLAGS} FROM keyed JOIN light USING (rid) JOIN deep USING (rid) JOIN tags USING (rid) JOIN modelled USING (rid)""",
        "light deep tags modelled")
    q["model_sentiment"] = _sql("SELECT review_id, model_label, model_confidence FROM modelled JOIN keyed USING (rid)", "modelled")
    q["external_model_sentiment"] = _sql("""SELECT review_id, CASE WHEN contains(clean_light, '!') THEN 'positive' WHEN contains(clean_light, '?')
      THEN 'neutral' ELSE 'negative' END AS label, round_even(1 / (1 + length(clean_light)), 8) AS score
      FROM light JOIN keyed USING (rid)""", "light", "both")
    q["run_sentiment"] = _sql("""SELECT review_id, compound AS vader_score, label AS vader_label, model_label AS transformer_label,
      model_confidence AS transformer_confidence, truth AS rating_sentiment
      FROM keyed JOIN scored USING (rid) JOIN modelled USING (rid) JOIN truth USING (rid)""", "scored modelled truth")
    q["analyze"] = _sql(f"""SELECT dataset_id, review_id, clean_light, clean_deep, word_count, sentiment, confidence, aspects, {FLAGS}
      FROM analyzed""", "analyzed", "both")
    # aspects and topics
    q["tag_aspects"] = _sql("SELECT dataset_id, review_id, aspects FROM tags JOIN keyed USING (rid)", "tags", "both")
    q["tag_aspects_tables"] = _sql("SELECT review_id, aspects FROM tags JOIN keyed USING (rid)", "tags")
    q["aspect_onehot"] = _sql(f"SELECT review_id, {FLAGS} FROM tags JOIN keyed USING (rid)", "tags")
    q["topic_discover"] = "SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first_id FROM embeddings"
    q["topic_keywords_ctfidf"] = _sql("SELECT source, position, term, tf, weight FROM keywords", "keywords")
    q["topic_info"] = _sql("""SELECT source, n, concat(source, '_', string_agg(term, '_' ORDER BY position) FILTER (position <= 4)) AS name,
      string_agg(term, ',' ORDER BY position) AS keywords FROM keywords JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)
      GROUP BY source, n""", "keywords")
    q["topic_representatives"] = """
      WITH flat AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      means AS (SELECT label, dim, avg(x) AS m FROM flat GROUP BY label, dim),
      near AS (SELECT label, vec_id, round_even(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM flat JOIN means USING (label, dim) GROUP BY label, vec_id)
      SELECT * FROM (SELECT label, vec_id, distance, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS INT) AS position FROM near)
      WHERE position <= 3"""
    q["topic_lexicon_gap"] = _sql("""SELECT source, n, share_without_aspect, coalesce(missed_keywords, 0) AS missed_keywords FROM (
      SELECT source, count(*) AS n, round_even(avg(CAST(aspects = '' AS INT)), 6) AS share_without_aspect
      FROM tags JOIN keyed USING (rid) JOIN documents ON doc_id = review_id GROUP BY source)
      LEFT JOIN (SELECT source, count(*) AS missed_keywords FROM keywords WHERE term NOT IN (SELECT keyword FROM lexicon) GROUP BY source)
      USING (source)""", "tags keywords lexicon")
    # aggregations
    q["sentiment_counts"] = _sql("SELECT dataset_id, sentiment, count(*) AS n FROM analyzed GROUP BY ALL", "analyzed", "both")
    q["aspect_sentiment_summary"] = _sql("SELECT * FROM by_aspect", "by_aspect", "both")
    q["aspect_summary_zero_filled"] = _sql("SELECT * FROM every_aspect", "every_aspect", "both")
    q["headline_metrics"] = _sql("""SELECT dataset_id, count(*) AS total, round_even(100.0 * count(*) FILTER (sentiment = 'positive') / count(*), 6) AS pct_positive,
      round_even(100.0 * count(*) FILTER (sentiment = 'negative') / count(*), 6) AS pct_negative FROM analyzed GROUP BY dataset_id""", "analyzed", "both")
    q["sentiment_daily"] = _sql("""SELECT dataset_id, TRY_CAST(review_date AS DATE) AS day, sentiment, count(*) AS n FROM analyzed
      WHERE TRY_CAST(review_date AS DATE) IS NOT NULL GROUP BY ALL""", "analyzed", "both")
    q["sentiment_daily_mixed"] = _sql("SELECT dataset_id, day, sentiment, count(*) AS n FROM dated WHERE written GROUP BY ALL", "dated")
    q["date_layouts"] = _sql("""SELECT *, CASE WHEN day_first > month_first THEN 'day first' ELSE 'month first' END AS layout FROM (
      SELECT dataset_id, count(*) FILTER (written AND (NOT two_ways OR dataset_id = 'docs_en' OR day(day) <= 12)) AS month_first,
             count(*) FILTER (written AND (NOT two_ways OR dataset_id = 'docs_fr' OR day(day) <= 12)) AS day_first FROM dated GROUP BY dataset_id)""", "dated")
    q["dates_present"] = _sql("SELECT dataset_id, bool_or(review_date IS NOT NULL) AS has_dates FROM reviews GROUP BY dataset_id", "reviews", "both")
    q["rating_distribution"] = _sql("SELECT rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY rating", "reviews", "both")
    q["loader_profile"] = _sql(f"""SELECT part, CAST(ordinal AS INT) AS ordinal, name, value FROM (
      SELECT 'rows' AS part, 0 AS ordinal, 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM reviews
      UNION ALL SELECT 'words', 0, 'mean', CAST(round_even(avg({_WORDS.format('review_text')}), 1) AS VARCHAR) FROM reviews
      UNION ALL SELECT * FROM ({_values(("column", i, c, t) for i, (c, t) in enumerate([("review_id", "bigint"), ("dataset_id", "string"),
                                ("review_text", "string"), ("rating", "double"), ("review_date", "string")]))})
      UNION ALL SELECT 'rating', row_number() OVER (ORDER BY rating) - 1, CAST(rating AS VARCHAR), CAST(count(*) AS VARCHAR) FROM reviews WHERE rating IS NOT NULL GROUP BY rating
      UNION ALL (SELECT 'sample', row_number() OVER (ORDER BY review_id) - 1, CAST(review_id AS VARCHAR), review_text FROM reviews ORDER BY review_id LIMIT 3))""", "reviews")
    q["avg_words"] = _sql(f"SELECT round_even(avg({_WORDS.format('review_text')}), 1) AS avg_words FROM reviews", "reviews")
    q["avg_words_by_rating"] = _sql(f"""SELECT rating, round_even(avg({_WORDS.format('review_text')}), 1) AS avg_words
      FROM reviews WHERE rating IS NOT NULL GROUP BY rating""", "reviews")
    q["top_words"] = _sql(TOP_WORDS.format(""), "kept", "both")
    q["negative_top_words"] = _sql(TOP_WORDS.format("SEMI JOIN (SELECT rid FROM scored WHERE label = 'negative') USING (rid)"), "kept scored", "both")
    q["model_agreement"] = _sql("""SELECT round_even(avg(CAST(coalesce(context_label = truth, false) AS INT)), 6) AS agreement FROM judged""", "judged", "both")
    q["confusion_matrix"] = _sql("SELECT CAST(ordinal AS INT) AS ordinal, label AS true_label, " + ", ".join(
        f"count(*) FILTER (truth = label AND context_label = '{p}') AS {p}" for p in vocab.EVALUATION_LABELS)
        + " FROM labels3 CROSS JOIN judged GROUP BY ordinal, label", "judged labels3", "both")
    q["classification_metrics"] = _sql("""SELECT model, n, round_even(accuracy, 6) AS accuracy, round_even(avg(precision), 6) AS precision_macro,
      round_even(avg(recall), 6) AS recall_macro, round_even(avg(f1), 6) AS f1_macro
      FROM label_metrics JOIN (SELECT model, count(*) AS n, avg(CAST(truth = said AS INT)) AS accuracy FROM long_judged GROUP BY model) USING (model)
      GROUP BY model, n, accuracy""", "label_metrics", "both")
    q["classification_report"] = _sql("""SELECT model, CAST(ordinal AS INT) AS ordinal, label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
      round_even(f1, 6) AS f1, support FROM (
      SELECT model, ordinal, label, precision, recall, f1, support FROM label_metrics
      UNION ALL SELECT model, 3, 'accuracy', NULL, NULL, avg(CAST(truth = said AS INT)), count(*) FROM long_judged GROUP BY model
      UNION ALL SELECT model, 4, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM label_metrics GROUP BY model
      UNION ALL SELECT model, 5, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM label_metrics GROUP BY model)""", "label_metrics", "both")
    q["word_count_histogram"] = f"""WITH counted AS (SELECT {_WORDS.format('text')} AS v FROM documents),
      bounds AS (SELECT min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo, max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi FROM counted)
      SELECT bin, round_even(lo + bin * (hi - lo) / 20, 6) AS bin_start, round_even(lo + (bin + 1) * (hi - lo) / 20, 6) AS bin_end, coalesce(n, 0) AS n
      FROM (SELECT unnest(range(20)) AS bin) CROSS JOIN bounds
      LEFT JOIN (SELECT least(19, CAST(floor((v - lo) / ((hi - lo) / 20)) AS BIGINT)) AS bin, count(*) AS n FROM counted, bounds GROUP BY 1) USING (bin)"""
    q["list_datasets"] = _sql("SELECT DISTINCT dataset_id FROM reviews", "reviews", "both")
    # joins, rankings, documents
    q["negative_examples"] = _sql("SELECT dataset_id, aspect, position, review_id, review_text FROM examples", "examples", "both")
    q["negative_examples_one_aspect"] = _sql("""SELECT review_id, review_text FROM examples WHERE dataset_id = '1-URGENT' AND aspect = 'delivery'
      AND review_text <> ''""", "examples", "both")
    q["complaint_examples"] = _sql("SELECT * FROM snippets", "snippets", "both")
    for name, kind in (("complaints", "negative"), ("praise", "positive")):
        q[f"top_{name}"] = _sql(f"""SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY {kind}_share DESC, {kind} DESC, aspect_ord) AS INT) AS position,
          aspect, {kind}_share, {kind} FROM every_aspect WHERE total > 0""", "every_aspect", "both")
        q[f"top5_{name}"] = _sql(f"""SELECT dataset_id, position, aspect, round_even(share, 9) AS {kind}_share FROM (
          SELECT dataset_id, aspect, {kind} / total AS share, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY {kind} / total DESC, aspect) AS INT) AS position
          FROM by_aspect) WHERE position <= 5""", "by_aspect", "both")
    q["recommendations_ranked"] = _sql("""SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY
        CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, given) AS INT) AS position, aspect, priority, finding, recommendation
      FROM (SELECT answer_id, given, json_extract_string(item, '$.aspect') AS aspect, coalesce(json_extract_string(item, '$.priority'), 'low') AS priority,
                   json_extract_string(item, '$.finding') AS finding, json_extract_string(item, '$.recommendation') AS recommendation
            FROM recommendations)""", "recommendations")
    q["aspect_sentiment_long"] = _sql("""SELECT dataset_id, aspect, total, sentiment, n
      FROM (UNPIVOT by_aspect ON positive, neutral, negative INTO NAME sentiment VALUE n)""", "by_aspect", "both")
    q["aspect_breakdown"] = _sql("""SELECT dataset_id, aspect, total AS total_mentions, positive, neutral, negative,
      round_even(negative / total, 3) AS negative_share, round_even(positive / total, 3) AS positive_share FROM by_aspect""", "by_aspect", "both")
    q["strategy_context"] = _sql("""SELECT dataset_id, total_reviews, counts, breakdown, top, snippets FROM
      (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS total_reviews, string_agg(concat(sentiment, '=', n), ',' ORDER BY sentiment) AS counts
       FROM (SELECT dataset_id, sentiment, count(*) AS n FROM analyzed GROUP BY ALL) GROUP BY dataset_id)
      LEFT JOIN (SELECT dataset_id, string_agg(concat_ws('/', aspect, total, positive, neutral, negative), ',' ORDER BY total DESC, aspect) AS breakdown
                 FROM by_aspect GROUP BY dataset_id) USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, string_agg(aspect, ',' ORDER BY rank) AS top FROM complaints GROUP BY dataset_id) USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, string_agg(snippet, '|' ORDER BY rank, position) AS snippets FROM snippets JOIN complaints USING (dataset_id, aspect)
                 GROUP BY dataset_id) USING (dataset_id)""", "analyzed by_aspect complaints snippets", "both")
    q["strategy_prompt_fields"] = _sql("""SELECT dataset_id, total_reviews, top, breakdown FROM
      (SELECT dataset_id, count(*) AS total_reviews FROM analyzed GROUP BY dataset_id)
      JOIN (SELECT dataset_id, string_agg(aspect, ',' ORDER BY rank) AS top FROM complaints GROUP BY dataset_id) USING (dataset_id)
      JOIN (SELECT dataset_id, string_agg(concat_ws('/', aspect, total), ',' ORDER BY total DESC, aspect) AS breakdown
            FROM by_aspect GROUP BY dataset_id) USING (dataset_id)""", "analyzed by_aspect complaints", "both")
    counts = "string_agg(concat(to_json(coalesce(sentiment, 'null')), ':', n), ',' ORDER BY coalesce(sentiment, 'null'))"
    kinds = ", ".join(f"',\"{k}\":', {k}" for k in vocab.SENTIMENTS)
    entry = f"""concat('{{"aspect":', to_json(aspect), ',"total_mentions":', total, {kinds},
      ',"negative_share":', to_json(round_even(negative / total, 3)), ',"positive_share":', to_json(round_even(positive / total, 3)), '}}')"""
    q["strategy_prompt"] = _sql(f"""SELECT dataset_id, concat({_text(PROMPT_PREFACE)}, '{{"dataset_id":', to_json(dataset_id), ',"total_reviews":', total_reviews,
      ',"sentiment_counts":{{', counts, '}},"aspect_breakdown":[', coalesce(breakdown, ''), '],"top_complaint_aspects":[', coalesce(top, ''),
      '],"example_negative_reviews":{{', coalesce(quoted, ''), '}}}}', {_text(PROMPT_SCHEMA)}) AS prompt FROM
      (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS total_reviews, {counts} AS counts FROM (SELECT dataset_id, sentiment, count(*) AS n FROM analyzed GROUP BY ALL) GROUP BY dataset_id)
      LEFT JOIN (SELECT dataset_id, string_agg({entry}, ',' ORDER BY total DESC, aspect) AS breakdown FROM by_aspect GROUP BY dataset_id) USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, string_agg(to_json(aspect), ',' ORDER BY rank) AS top,
                        string_agg(concat(to_json(aspect), ':[', coalesce(said, ''), ']'), ',' ORDER BY rank) AS quoted
                 FROM complaints LEFT JOIN (SELECT dataset_id, aspect, string_agg(to_json(snippet), ',' ORDER BY position) AS said FROM snippets GROUP BY ALL) USING (dataset_id, aspect)
                 GROUP BY dataset_id) USING (dataset_id)""", "analyzed by_aspect complaints snippets", "both")
    q["strategy_answers"] = _sql("""SELECT dataset_id, concat(dataset_id, ' has ', total, ' reviews') AS executive_summary, coalesce(aspect, 'nothing') AS aspect,
      count(*) OVER () AS asked FROM (SELECT dataset_id, count(*) AS total FROM analyzed GROUP BY dataset_id)
      LEFT JOIN (SELECT dataset_id, aspect FROM complaints WHERE rank = 1) USING (dataset_id)""", "analyzed complaints", "both")
    return q
