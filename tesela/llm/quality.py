"""Text quality statistics: per-document figures, quantile sketches per language, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

# Common words of running text (connectives, pronouns, auxiliaries, frequent legal verbs).
# Articles and "de" are left out on purpose, since entries of lists hold them too.
COMMON = {
    "es": (
        "a al ante aquel bajo con contra desde durante en entre esta este esto está están ha habrá han hasta le les lo los "
        "mediante mientras ni no o para pero por que se según será serán si sin sobre su sus tendrá tras un una y "
        "e u cuando como donde más es son debe deberá deberán podrá podrán pudiera puede queda corresponde comprende "
        "responderán responderá entiende admitirá conforme respecto dentro cada véase publíquese"
    ).split(),
    "pt": (
        "ao aos às até com compreende decorridos desde deverá e em enquanto é está fica mediante na nas no nos não "
        "ou para pela pelo perante poderá por quando que respondem sem ser será sob são terá um uma cabe"
    ).split(),
    "en": (
        "after and any are at be before behalf but by for from has have in includes is it its may means must not on "
        "once or pending shall subject that this to under undertakes unless until up which while will with within without"
    ).split(),
}
# Words by which a language shows.
MARKS = {
    "es": "el la los las del y al se en por una con".split(),
    "pt": "o os as da do das dos ao em no na não uma com".split(),
    "en": "the of and to in for is by shall may with or".split(),
}
STATS = ("mean_word_len", "symbol_ratio", "digit_word_ratio", "line_end_share", "common_share", "distinct_share", "words_per_line", "short_line_share", "separator_share")


def _any(words: list[str]) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"


def document_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of each text as columns (all of them JVM expressions, no shuffle).

    null text: the counts are 0 and the ratios null; ``language`` is 'und' where no marking word
    occurs. The columns ``__*`` of the input are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), 1)
    # the marks of entries ("a.", "iv)", "1.2") are no words of the text
    plain = F.regexp_replace(t, r"(?m)(?<![\p{L}\p{N}])(?:[ivxlIVXL]{1,5}|\p{L}|\p{N}{1,3})[.)](?:\p{N}{1,2})?(?=\s)", " ")
    lines = F.filter(F.split(t, r"\n"), lambda x: F.trim(x) != "")
    df = df.withColumns({"__t": t, "__w": words, "__p": F.lower(plain), "__l": lines})
    n_words = F.size("__w")
    n_lines = F.size("__l")
    n_plain = F.greatest(F.regexp_count("__p", F.lit(WORD)), F.lit(1))
    hits = {k: F.regexp_count("__p", F.lit(_any(v))) for k, v in MARKS.items()}
    df = df.withColumns({f"__{k}": v for k, v in hits.items()})
    best = F.greatest("__es", "__pt", "__en")
    language = F.when(best == 0, "und").when(F.col("__es") == best, "es").when(F.col("__pt") == best, "pt").otherwise("en")

    def per(x: Column, n: Column) -> Column:
        return F.when(n > 0, x / n)

    letters = F.length(F.regexp_replace("__t", r"[^\p{L}\p{N}]+", ""))
    marks = F.length(F.regexp_replace("__t", r"[\p{L}\p{N}\p{M}\s]+", ""))
    found = {k: F.regexp_count("__p", F.lit(_any(v))) for k, v in COMMON.items()}
    common = F.when(language == "es", found["es"]).when(language == "pt", found["pt"]).when(language == "en", found["en"]).otherwise(F.greatest(*found.values()))
    df = df.withColumns(
        {
            "language": language,
            "n_chars": F.length("__t"),
            "n_words": n_words,
            "n_lines": n_lines,
            "mean_word_len": per(letters, n_words),
            "symbol_ratio": per(marks, F.length("__t")),
            "digit_word_ratio": per(F.regexp_count("__t", F.lit(r"(?<![\p{L}\p{N}])\p{N}[\p{L}\p{N}]*")), n_words),
            "line_end_share": per(F.size(F.filter("__l", lambda x: x.rlike(r"[.!?…:;][\"”»')\]]*\s*$"))), n_lines),
            "common_share": F.when(n_words > 0, common / n_plain),
            "distinct_share": per(F.size(F.array_distinct("__w")), n_words),
            "words_per_line": per(n_words, n_lines),
            "separator_share": per(F.regexp_count("__t", F.lit(r"\s[/|•·–—-]\s|;")), n_words),
            "short_line_share": per(F.aggregate(F.filter("__l", lambda x: F.regexp_count(x, F.lit(WORD)) < 7), F.lit(0), lambda a, x: a + F.length(x)), F.length("__t")),
        }
    )
    return df.drop("__t", "__w", "__p", "__l", "__es", "__pt", "__en")


def sketches(stats: DataFrame, group: str = "language", k: int = 400) -> DataFrame:
    """One mergeable KLL sketch for each statistic and language.

    Partial sketches are made before the shuffle, so that each task sends one small row per language,
    however many rows a language has.
    """
    return stats.groupBy(group).agg(*(F.kll_sketch_agg_double(F.col(s).cast("double"), k).alias(s) for s in STATS))


def profile(sk: DataFrame, group: str = "language") -> DataFrame:
    """Median and robust scale of each statistic, taken from the sketches: one row per language."""

    def q(s: str, p: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(F.col(s), F.lit(p)))

    cols = []
    for s in STATS:
        cols += [q(s, 0.5).alias(f"{s}_med"), F.greatest((q(s, 0.75) - q(s, 0.25)) / 1.349, F.lit(1e-3)).alias(f"{s}_scale")]
    return sk.select(group, *cols)


def robust_z(stats: DataFrame, group: str = "language", sk: DataFrame | None = None) -> DataFrame:
    """Adds ``z_<statistic>``, the robust z-score of each statistic within its language.

    The profile has one row per language that ``document_stats`` can give (4 at most), hence the broadcast.
    """
    prof = profile(sk if sk is not None else sketches(stats, group), group)
    out = stats.join(F.broadcast(prof), group)
    out = out.withColumns({f"z_{s}": (F.col(s) - F.col(f"{s}_med")) / F.col(f"{s}_scale") for s in STATS})
    return out.drop(*[f"{s}_{x}" for s in STATS for x in ("med", "scale")])


#: Tails that mark a text as no prose.
FAR_TAIL, MID_TAIL, NEAR_TAIL = -3.8, -2.5, -1.9


def no_prose(z: DataFrame) -> Column:
    """Whether the text is mostly no sentences: in the far tail of common words, or in the near tail with
    a second statistic in its own tail (short lines, digits, separators, repeated words)."""
    common = F.col("z_common_share")
    second = (F.col("short_line_share") > 0.9) | ((F.col("short_line_share") > 0.5) & (common < MID_TAIL)) | (F.col("digit_word_ratio") > 0.3) | (F.col("separator_share") > 0.125) | ((F.col("distinct_share") < 0.3) & (F.col("n_words") > 20)) | (F.col("symbol_ratio") > 0.12)
    und = F.col("language") == "und"
    encoded = F.col("mean_word_len") > 12
    return (F.col("n_words") == 0) | encoded | (common < FAR_TAIL) | ((common < NEAR_TAIL) & second) | (und & ((F.col("common_share") < 0.1) | (F.col("short_line_share") > 0.9)))


def quality(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Key, statistics, robust z-scores and ``is_prose`` of every row of ``df``; other columns don't come along.

    A text without words is no prose; a null text gives ``is_prose`` null. Equal rows stay. The figures are
    checkpointed once, since the sketches and the scores both read them.
    """
    kept = document_stats(df.select(F.col(key), F.col(text).alias("__text")), "__text")
    stats = cut(kept.withColumn("__null", F.col("__text").isNull()).drop("__text"))
    scored = robust_z(stats)
    return scored.withColumn("is_prose", F.when(~F.col("__null"), ~no_prose(scored))).drop("__null")
