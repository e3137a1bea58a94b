"""Rule-based checks of a source and its answer, as one array of flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import text as T

#: Flags in their order; the numbers are the limits.
UNTRANSLATED, WRONG_SCRIPT, SHORT_TEXT = 0.3, 0.3, 12
LONG_ENOUGH, TOO_SHORT, TOO_LONG = 25, 0.4, 3.0


def _share(c: Column, language: Column) -> Column:
    script = T.lookup(T.base_language(language), T.SCRIPT_OF)
    out = F.lit(0.0)
    for name in T.SCRIPTS:
        out = F.when(script == name, T.script_share(c, name)).otherwise(out)
    return out


def flags(source: Column, target: Column, source_lang: Column, target_lang: Column) -> Column:
    """Array of flags of one pair, in a fixed order.

    A null or blank answer has the single flag ``empty``.  A null source counts as an empty text.
    """
    source = F.coalesce(source, F.lit(""))
    s, t = T.visible(source), T.visible(target)
    own, other = T.tag_ids(source), T.tag_ids(target)
    gone, extra = F.array_except(own, other), F.array_except(other, own)
    digits_s, digits_t = T.number_digits(s), T.number_digits(t)
    raw_s, raw_t = F.array_sort(T.numbers(s)), F.array_sort(T.numbers(t))
    script_s, script_t = T.lookup(T.base_language(source_lang), T.SCRIPT_OF), T.lookup(T.base_language(target_lang), T.SCRIPT_OF)
    differs = F.coalesce(script_s != script_t, F.lit(False))
    ratio = F.length(t) / F.greatest(F.length(s), F.lit(1))
    long_enough = F.length(s) >= LONG_ENOUGH
    some = F.array(
        F.when(F.size(gone) > 0, F.concat(F.lit("tags_missing:"), F.array_join(gone, ","))),
        F.when(F.size(extra) > 0, F.concat(F.lit("tags_extra:"), F.array_join(extra, ","))),
        F.when(digits_s != digits_t, F.lit("numbers_mismatch")).when(raw_s != raw_t, F.lit("separator_changed")),
        F.when(F.size(T.ambiguous_numbers(s)) > 0, F.concat(F.lit("ambiguous_separator:"), F.array_join(T.ambiguous_numbers(s), ","))),
        F.when(differs & (_share(t, source_lang) > UNTRANSLATED), F.lit("untranslated")).when(differs & (_share(t, target_lang) < WRONG_SCRIPT) & (F.length(t) > SHORT_TEXT), F.lit("wrong_script")),
        F.when(T.repeats_word(t) & ~T.repeats_word(s), F.lit("duplicated_word")),
        F.when(long_enough & (ratio < TOO_SHORT), F.lit("too_short")).when(long_enough & (ratio > TOO_LONG), F.lit("too_long")),
    )
    return F.when(F.coalesce(t, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(F.array_compact(some))
