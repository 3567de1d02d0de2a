"""Texts cut off by a field limit or in transfer (problem 9), in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postloom.plans.lineage import cut

#: A mark put after a cut; with the bounds in it, none is longer than ``_LONGEST_MARK`` characters.
MARK = r"(?is)\s{0,9}(\[\s{0,9}(\.{2,9}|…|truncated|cut|clipped|snip|more|gekürzt|tronqué|cortado)[^\]\n]{0,40}\]|\(\s{0,9}(\.{2,9}|…|truncated|cut|clipped|snip|more)[^)\n]{0,40}\)|<\s{0,9}(\.{2,9}|…|truncated|cut|clipped|snip|more)[^>\n]{0,40}>|…|\.{3,40}|\uFFFD{1,40}|[-*=~_]{2,40}\s{0,9}(truncated|cut|clipped|snip|message truncated|text truncated)[^\n]{0,40})$"
_LONGEST_MARK = 160
_BLANKS = " \n\r\t\f\x0b\xa0"
_NUMBER, _CAPITALISED = r"[0-9]+(?:[.,:/][0-9]+)*", r"\p{Lu}[\p{L}\p{M}]*"


def find_truncated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_terminal: float = 0.02, z: float = 1.0, hot: int = 1_000_000) -> DataFrame:
    """(id, source, truncated, level) for each row with an id.

    Words are what stands between blanks, in a coarse form (numbers and capitalised words are one class each, line ends are kept on the word).
    All trigrams of all texts are counted inside texts and at their ends. A text is cut when its last trigram, whose last word may be the
    beginning of a longer one, is frequent inside texts, yet almost never ends one: an upper bound of the share of ends among its other
    occurrences (Wilson's, at ``z``) is at most ``max_terminal``. It is whole when a lower bound of that share is above. Where neither is sure, as the trigram is
    rare, its last two words decide in the same way, then, unless other texts end with these two words at half that share or more, its last
    word; ``level`` tells how many words decided.

    A text that ends in a full stop, question or exclamation mark is whole (level 0). A mark such as "[...]" or a broken character after the
    cut is taken off first; it decides (level 0) where no level is sure, and such a text without mark is whole.

    Null and blank texts are not cut. Repeated ids give one row for each. Endings that ``hot`` texts and more share are joined by broadcast;
    there are at most as many as rows divided by ``hot``.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr(f"`{id_col}` AS id", f"`{source_col}` AS source", f"`{text_col}` AS text").filter("id IS NOT NULL")
    grams = spark.sql(
        """
        WITH whole AS (SELECT id, CASE WHEN rtrim(:blanks, right(text, :tail)) = '' THEN rtrim(:blanks, text) ELSE text END AS text FROM {docs} WHERE text IS NOT NULL),
        parts AS (SELECT id, left(text, length(text) - 2 * :tail) AS head, rtrim(:blanks, right(text, 2 * :tail)) AS tail FROM whole),
        marks AS (SELECT id, head, tail, right(tail, :tail) RLIKE :mark AS marked FROM parts),
        shaped AS (SELECT id, marked, regexp_replace(regexp_replace(replace(ltrim(:blanks, concat(head, CASE WHEN marked THEN rtrim(:blanks, concat(left(tail, length(tail) - :tail), regexp_replace(right(tail, :tail), :mark, ''))) ELSE tail END)), '\n', '¶ '), :number, '0'), :capitalised, 'A') AS text FROM marks),
        words AS (SELECT id, marked, array(split(concat('^ ^ ', text), ' ')) AS once FROM shaped)
        SELECT element_at(transform(once, t -> transform(slice(t, 3, size(t)), (x, i) ->
                 concat(t[i], ' ', t[i + 1], ' ', x, CASE WHEN i = size(t) - 3 THEN concat(' ', id, ' ', marked) ELSE '' END))), 1) AS g
        FROM words
        """,
        args={"mark": MARK, "number": _NUMBER, "capitalised": _CAPITALISED, "tail": _LONGEST_MARK, "blanks": _BLANKS},
        docs=docs,
    )
    # One pass over the texts (explode_outer, as the filter inferred for explode would do all the work twice): trigrams inside texts are counted as strings, the last one of each text carries its id. Keys are made of the distinct ones.
    counted = cut(
        spark.sql(
            """
            WITH distinct_grams AS (SELECT split(x, ' ') AS p, n FROM (SELECT x, count(*) AS n FROM (SELECT explode_outer(g) AS x FROM {grams}) GROUP BY x, xxhash64(x)))
            SELECT xxhash64(p[0], p[1]) AS c, xxhash64(p[1]) AS b, rtrim('¶', p[2]) AS w, CAST(get(p, 3) AS bigint) AS id, CAST(get(p, 4) AS boolean) AS marked, n FROM distinct_grams WHERE p[2] <> '' OR p[1] <> '^'
            """,
            grams=grams,
        )
    )
    last = spark.sql("SELECT id, marked, c, b, w FROM {counted} WHERE id IS NOT NULL", counted=counted)
    endings = cut(spark.sql("SELECT c, b, w, count(*) AS n FROM {last} GROUP BY c, b, w", last=last))
    # What ends at each level, and which beginnings of words are asked for: of a key's inner words only prefixes of these lengths are made.
    levels = spark.sql("SELECT x.level AS level, x.k AS k, w, sum(n) AS n FROM (SELECT w, n, explode(array(named_struct('level', 3, 'k', c), named_struct('level', 2, 'k', b), named_struct('level', 1, 'k', 0L))) AS x FROM {endings}) GROUP BY 1, 2, 3", endings=endings)
    inner = spark.sql("SELECT x.level AS level, x.k AS k, w, sum(n) AS n FROM (SELECT w, n, explode(array(named_struct('level', 3, 'k', c), named_struct('level', 2, 'k', b), named_struct('level', 1, 'k', 0L))) AS x FROM {counted} WHERE id IS NULL) GROUP BY 1, 2, 3", counted=counted)
    judged = spark.sql(
        f"""
        WITH lengths AS (SELECT level, k, collect_set(length(w)) AS sizes FROM {{levels}} GROUP BY 1, 2),
        met AS (
          SELECT i.level, i.k, i.w, i.n, s.sizes FROM {{inner}} AS i JOIN lengths AS s ON i.level = s.level AND i.k = s.k WHERE i.level > 1
          UNION ALL SELECT /*+ BROADCAST(s) */ i.level, i.k, i.w, i.n, s.sizes FROM {{inner}} AS i JOIN (SELECT * FROM lengths WHERE level = 1) AS s ON i.level = s.level WHERE i.level = 1
        ),
        inside AS (SELECT level, k, w, sum(n) AS n FROM (SELECT level, k, n, explode(transform(filter(sizes, x -> x <= length(w)), x -> left(w, x))) AS w FROM met) GROUP BY 1, 2, 3),
        others AS (SELECT e.level, e.k, e.w, CAST(e.n - 1 AS double) AS ends, CAST(coalesce(i.n, 0) + e.n - 1 AS double) AS seen FROM {{levels}} AS e LEFT JOIN inside AS i ON i.level = e.level AND i.k = e.k AND i.w = e.w),
        bounds AS (SELECT *, (ends + {z * z} / 2) / (seen + {z * z}) AS middle, {z} * sqrt(ends * (seen - ends) / greatest(seen, 1) + {z * z} / 4) / (seen + {z * z}) AS way FROM others)
        SELECT level, k, w, CASE WHEN middle + way <= {max_terminal} THEN true WHEN middle - way > {max_terminal} THEN false END AS cut, ends > {max_terminal} / 2 * seen AS over FROM bounds
        """,
        levels=levels,
        inner=inner,
    )
    judged = cut(judged.filter("cut IS NOT NULL OR over"))
    verdicts = spark.sql(
        """
        SELECT e.c, e.b, e.w, e.n, CASE WHEN e.w RLIKE '[.?!]$' THEN false ELSE coalesce(t.cut, d.cut, CASE WHEN d.over THEN false END, o.cut) END AS cut,
               CASE WHEN e.w RLIKE '[.?!]$' THEN 0 WHEN t.cut IS NOT NULL THEN 3 WHEN d.cut IS NOT NULL OR d.over THEN 2 WHEN o.cut IS NOT NULL THEN 1 ELSE 0 END AS level
        FROM {endings} AS e LEFT JOIN (SELECT * FROM {judged} WHERE level = 3) AS t ON t.k = e.c AND t.w = e.w LEFT JOIN (SELECT * FROM {judged} WHERE level = 2) AS d ON d.k = e.b AND d.w = e.w LEFT JOIN (SELECT * FROM {judged} WHERE level = 1) AS o ON o.w = e.w
        """,
        endings=endings,
        judged=judged,
    )
    verdicts = cut(verdicts)
    return spark.sql(
        f"""
        WITH shared AS (SELECT /*+ BROADCAST(v) */ l.id, l.marked, l.c, l.b, l.w, v.n IS NOT NULL AS known, v.cut, v.level FROM {{last}} AS l LEFT JOIN (SELECT * FROM {{verdicts}} WHERE n >= {hot}) AS v ON l.c = v.c AND l.b = v.b AND l.w = v.w),
        found AS (
          SELECT id, coalesce(cut, marked) AS truncated, level FROM shared WHERE known
          UNION ALL SELECT l.id, coalesce(v.cut, l.marked), v.level FROM (SELECT * FROM shared WHERE NOT known) AS l JOIN (SELECT * FROM {{verdicts}} WHERE n < {hot}) AS v ON l.c = v.c AND l.b = v.b AND l.w = v.w
        )
        SELECT d.id, d.source, coalesce(f.truncated, false) AS truncated, coalesce(f.level, 0) AS level FROM {{docs}} AS d LEFT JOIN found AS f ON f.id = d.id
        """,
        last=last,
        verdicts=verdicts,
        docs=docs,
    )


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    return found.sparkSession.sql("SELECT source, count(*) AS n_docs, count_if(truncated) AS n_truncated, count_if(truncated) / count(*) AS rate FROM {found} GROUP BY source", found=found)
