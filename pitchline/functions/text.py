"""Text columns: names, headings, page facts and delimited lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def canonical(name: Column, aliases: Mapping[str, str]) -> Column:
    """Trimmed name, replaced where an alias is known."""
    clean = F.trim(name)
    if not aliases:
        return clean
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(known, clean), clean)


def rename_inside(text: Column, renames: Mapping[str, str]) -> Column:
    for old, new in renames.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pair_side(text: Column, side: int, sep: str = " vs ") -> Column:
    """Side 1 or 2 of ``A vs B``; null for side 2 without the separator."""
    at = F.instr(text, sep)
    if side == 1:
        return F.trim(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text))
    return F.trim(F.when(at > 0, F.substr(text, at + len(sep))))


def heading_side(text: Column, side: int, sep: str = " vs ") -> Column:
    """Like ``pair_side``, empty without a separator, side 2 cut at the first comma."""
    at = F.instr(text, sep)
    part = squeeze(pair_side(text, side, sep))
    if side == 2:
        part = squeeze(F.substring_index(part, ",", 1))
    return F.when(at > 0, part).otherwise(F.lit(""))


def join_key(name: Column, unicode_letters: bool = False) -> Column:
    """Lower case with everything but letters and digits removed."""
    drop = r"[^\p{L}\p{N}]" if unicode_letters else "[^a-z0-9]"
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), drop, "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


_EDGE = "\u0001"


def _edged(text: Column) -> Column:
    """Lower case with a mark at every word edge, so whole words can be searched as plain text."""
    return F.regexp_replace(F.lower(text), r"\b", _EDGE)


def report_facts(df: DataFrame, text: str, team1: str, team2: str, aliases: Mapping[str, str]) -> DataFrame:
    """Adds toss_winner, toss_decision, winner, margin and date_text of a match report.

    Toss: ``X elected to bat|field``, else (side 1, field).  Winner: the side
    named before ``won by``, empty when neither is.  Every pattern is fixed
    and runs once per row; the row's own names are plain text searches.
    """
    body, a, b = F.col(text), F.col(team1), F.col(team2)
    toss = r"(?i)([A-Za-z .&-]+?) elected to (bat|field)"
    won = r"(?i)([A-Za-z .&-]+?) won by [A-Za-z0-9 .&-]+"

    def within(name: Column, part: Column) -> Column:
        return F.coalesce((part != "") & F.contains(name, part), F.lit(False))

    def named(team: Column) -> Column:
        mark = _edged(team)
        whole = F.startswith(mark, F.lit(_EDGE)) & F.endswith(mark, F.lit(_EDGE))
        return whole & F.contains(F.col("_marked"), F.concat(mark, F.lit(f" {_EDGE}won{_EDGE} {_EDGE}by")))

    # The open-ended patterns run only where their key words occur and nothing cheaper has answered.
    low = F.lower(body)
    staged = df.withColumns({
        "_toss": F.when(F.contains(low, F.lit(" elected to ")), first_group(body, toss, 0)),
        "_marked": _edged(F.regexp_replace(body, r"(?i)\s+won by", " won by")),
    }).withColumns({
        "_who": canonical(first_group(F.col("_toss"), toss, 1), aliases), "_what": F.lower(first_group(F.col("_toss"), toss, 2)),
        "_winner": F.when(named(a), a).when(named(b), b),
    }).withColumn("_other", canonical(F.when(
        F.col("_winner").isNull() & F.contains(low, F.lit(" won by ")), first_group(body, won)), aliases))
    who, other = F.col("_who"), F.col("_other")
    return staged.withColumns({
        "toss_winner": F.when(within(who, a), a).when(within(who, b), b).otherwise(a),
        "toss_decision": F.when(within(who, a) | within(who, b), F.col("_what")).otherwise(F.lit("field")),
        "winner": F.coalesce("_winner", F.when(within(other, a), a).when(within(other, b), b).otherwise(F.lit(""))),
        "margin": margin_fact(body), "date_text": date_fact(body),
    }).drop("_toss", "_marked", "_who", "_what", "_winner", "_other")


def margin_fact(text: Column) -> Column:
    """``42 runs`` / ``3 wickets`` after ``won by``."""
    return F.lower(first_group(text, r"(?i)won by (\d+ (?:runs?|wickets?|wkts?))"))


def date_fact(text: Column) -> Column:
    return F.coalesce(first_group(text, r"([A-Za-z]+\s+\d{1,2},\s+\d{4})"), F.lit(""))


def long_date(text: Column) -> Column:
    """``April 18, 2008`` as a date, null when malformed."""
    return F.try_to_date(squeeze(text), "MMMM d, yyyy")


def instant(text: Column) -> Column:
    """ISO text, with or without zone, as a UTC timestamp."""
    return F.try_to_timestamp(F.trim(text))


def venue_fact(html: Column, text: Column, unknown: str) -> Column:
    """Venue from embedded JSON, else from a ``Venue x, city`` phrase."""
    embedded = first_group(html, r'"location"\s*:\s*\{[^{}]*"name"\s*:\s*"([^"]+)"')
    phrase = r"Venue\s+([A-Za-z0-9,'&.\- ]{5,80}),\s*([A-Za-z .\-]{2,40})"
    spoken = F.when(
        F.rlike(text, F.lit(phrase)),
        F.concat_ws(", ", first_group(text, phrase, 1), first_group(text, phrase, 2)),
    )
    return squeeze(F.coalesce(embedded, spoken, F.lit(unknown)))


def last_score(text: Column, team: Column) -> Column:
    """struct(runs, wkts, overs) of the last ``team … 180-5 (20 Ovs)`` mention.

    The team's name is first replaced by a mark of the same length, so one
    fixed pattern serves every row.
    """
    mark, fill = "\u0001", "\u0002"
    pattern = (mark + fill + r"*[^0-9]{0,40}(\d{2,3})-(\d{1,2})(?:\s*\((\d{1,2}(?:\.\d)?)\s*ovs\))?")
    marked = F.replace(F.lower(text), F.lower(team), F.rpad(F.lit(mark), F.length(team), F.lit(fill)))
    last = F.try_element_at(F.regexp_extract_all(marked, F.lit(pattern), 0), F.lit(-1))
    return F.struct(*[
        first_group(last, pattern, i + 1).cast("double").alias(n) for i, n in enumerate(("runs", "wkts", "overs"))
    ])


def first_two_distinct_runs(values: Column) -> Column:
    """Drop values equal to their predecessor, keep the first two."""
    kept = F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))
    return F.slice(kept, 1, 2)


def powerplay_runs(text: Column) -> Column:
    """Powerplay totals of both innings in page order, duplicated blocks removed."""
    hits = F.regexp_extract_all(text, F.lit(r"(?i)Powerplays\s+Overs\s+Runs\s+Mandatory\s+0\.1\s*-\s*6\s*(\d+)"), 1)
    return first_two_distinct_runs(F.transform(hits, lambda x: x.cast("double")))


def strip_tags(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(body, "<[^>]*>", " "))


def tag_text(html: Column, tag: str) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def name_price_tokens(text: Column) -> Column:
    """Run-together ``Name12.5Name3`` text as array<struct<name, price>>."""
    pattern = r"([^0-9]+)([0-9]+(?:\.[0-9]+)?)"
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(hits, lambda h: F.struct(
        F.trim(F.regexp_extract(h, pattern, 1)).alias("name"),
        F.regexp_extract(h, pattern, 2).cast("double").alias("price"),
    ))


def text_list(cell: Column) -> Column:
    """List cell as JSON array, else ``|``-joined; blanks removed, null → empty."""
    clean = F.trim(F.coalesce(cell, F.lit("")))
    parsed = F.from_json(clean, "array<string>")
    parts = F.when(F.startswith(clean, F.lit("[")) & parsed.isNotNull(), parsed).otherwise(F.split(clean, r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
