"""Positions, drafts, schedules, evidence and states read out of loose values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What digits, marks and words of a position code stand for, the positions
#: that stand for themselves, and the letters that a code of digits and marks has none of.
DIGIT_POSITIONS = {"2": "C", "3": "1B", "4": "2B", "5": "3B", "6": "SS", "7": "LF", "8": "CF", "9": "RF"}
OTHER_MARKS = {"1": "P", "D": "DH", "H": "DH"}
WORD_POSITIONS = {
    "CATCHER": "C", "FIRST": "1B", "SECOND": "2B", "THIRD": "3B", "SHORTSTOP": "SS", "LEFTFIELD": "LF", "CENTERFIELD": "CF", "RIGHTFIELD": "RF",
    "DESIGNATEDHITTER": "DH", "PITCHER": "P", "STARTER": "P", "STARTINGPITCHER": "P", "RELIEVER": "RP", "RELIEFPITCHER": "RP",
}
HITTER_POSITIONS = ("C", "1B", "2B", "3B", "SS", "LF", "CF", "RF")
POSITIONS = (*HITTER_POSITIONS, "DH", "P", "RP")
WORD_LETTERS = "[ABCEFGI-QS-Z]"
PITCHERS = ("P", "LHP", "RHP", "SP", "RP")
#: Gates of trait evidence.
STRONG, COVERED_PILLARS, STRONG_PILLARS = 80.0, 3, 2


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def position_code(text: Column) -> Column:
    """The position that a code names: itself; of a code of digits and the marks H and D the
    first fielding digit, else D, 1 or H; else that of the first token which is a position,
    a word or mark for one, or begins with a mark. ``UNKNOWN`` if it says nothing."""
    raw = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(raw, "[*#]", "")
    code = F.regexp_replace(bare, r"[\s,/;-]+", "")
    compact = (code != "") & ~code.rlike(WORD_LETTERS)
    read = F.coalesce(_looked_up(DIGIT_POSITIONS, F.regexp_extract(code, "[2-9]", 0)), F.when(code.contains("D"), "DH").when(code.contains("1"), "P").when(code.contains("H"), "DH"))

    def position(token: Column) -> Column:
        known = DIGIT_POSITIONS | OTHER_MARKS
        return F.coalesce(_looked_up(known | WORD_POSITIONS | {p: p for p in POSITIONS}, token), _looked_up(known, F.substring(token, 1, 1)))

    tokens = F.transform(F.split(bare, r"[\s,/;-]+"), lambda t: position(F.regexp_replace(t, "[^A-Z0-9]", "")))
    walked = F.get(F.array_compact(tokens), F.lit(0))
    return F.when(raw.isin("", "NAN", "NONE", "<NA>"), "UNKNOWN").when(raw.isin(*POSITIONS), raw).otherwise(F.coalesce(F.when(compact, read), walked, F.lit("UNKNOWN")))


def role_of_positions(text: Column) -> Column:
    """``two_way`` with a pitcher's and another position, ``pitcher`` or ``hitter``."""
    bare = F.replace(F.upper(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))
    tokens = F.filter(F.split(bare, "[/,;-]"), lambda t: t != "")
    pitches = F.array_contains(tokens, "P") | bare.isin(*PITCHERS[1:])
    bats = F.exists(tokens, lambda t: ~t.isin(*PITCHERS))
    return F.when(pitches & bats, "two_way").when(pitches, "pitcher").otherwise("hitter")


def draft(text: Column) -> Column:
    """``year, round, acquisition`` of a draft note: international if it says J2 or INT, a
    draft if it has a year, else unknown."""
    t = F.trim(F.coalesce(text, F.lit("")))
    year = F.nullif(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    round_ = F.nullif(F.regexp_extract(t, r"(?i)(?:round|rd|r)\s*([0-9]+)", 1), F.lit(""))
    kind = F.when(F.upper(t).contains("J2") | F.upper(t).contains("INT"), "international").when(year.isNotNull(), "draft").otherwise("unknown")
    return F.struct(year.cast("double").alias("year"), round_.cast("double").alias("round"), kind.alias("acquisition"))


def next_scheduled(now: Column, minutes: tuple[int, ...]) -> Column:
    """The next of the daily times (minutes after midnight, UTC) strictly after ``now``."""
    if not minutes or any(not 0 <= m < 1440 for m in minutes):
        raise ValueError("minutes within a day are needed")
    day = F.date_trunc("day", now)
    times = [day + F.expr(f"interval {m} minutes") for m in sorted(set(minutes))]
    return F.coalesce(*[F.when(t > now, t) for t in times], times[0] + F.expr("interval 1 day"))


def valid_history(doc: Column, low: int, high: int, most: int = 31) -> Column:
    """The array of a JSON history: whole numbers within bounds or null, 1 to ``most`` of
    them; null for any other."""
    read = F.from_json(doc, "array<string>")
    numbers = F.transform(read, lambda x: F.when(x.rlike(r"^-?[0-9]{1,15}(\.0+)?$"), x.try_cast("double").cast("long")))
    fits = F.forall(F.zip_with(read, numbers, lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda p: p["x"].isNull() | F.coalesce(p["n"].between(low, high), F.lit(False)))
    return F.when(doc.rlike(r"^\s*\[") & F.size(read).between(1, most) & fits, numbers)


def trait_evidence(metrics: Column, pillars: dict[str, tuple[str, ...]], source: str) -> Column:
    """What an array of ``key, percentile, source`` metrics says of the pillars: ``covered``,
    ``strong`` (names), ``strongest`` (the best key of each covered pillar), whether that
    covers enough and is strong in more than one, and ``warnings``.

    Metrics of other keys are passed over; those of other sources or without a percentile
    from 0 to 100 do not count, nor does a key that comes twice."""
    supported = [k for keys in pillars.values() for k in keys]
    names = lambda a: F.array_join(F.transform(a, lambda b: b["pillar"]), ",")

    def best(once: Column) -> Column:
        tops = [F.array_min(F.transform(_of(once, own), lambda m: F.struct((-m["percentile"]).alias("p"), m["key"].alias("key")))) for own in pillars.values()]
        each = F.zip_with(F.array(*map(F.lit, pillars)), F.array(*tops), lambda name, t: F.struct(name.alias("pillar"), t["key"].alias("key"), (-t["p"]).alias("percentile")))
        return F.filter(each, lambda b: b["key"].isNotNull())

    def told(found: Column, strong: Column, foreign: Column) -> Column:
        enough = F.size(found) >= COVERED_PILLARS
        warnings = F.array_join(F.array_compact(F.array(F.when(~enough, "insufficient_pillar_coverage"), F.when(foreign, "unsupported_metric_source_excluded"))), ",")
        return F.struct(
            names(found).alias("covered"), names(strong).alias("strong"), F.array_join(F.transform(found, lambda b: b["key"]), ",").alias("strongest"),
            enough.alias("coverage_sufficient"), (F.size(strong) >= STRONG_PILLARS).alias("multi_pillar"), warnings.alias("warnings"),
        )

    def judged(named: Column) -> Column:
        foreign = F.coalesce(F.exists(named, lambda m: m["key"].isin(*supported) & (m["source"] != source)), F.lit(False))
        able = F.filter(named, lambda m: (m["source"] == source) & m["percentile"].between(0.0, 100.0))
        once = _bound(able, lambda a: F.filter(a, lambda m: F.size(F.filter(a, lambda o: o["key"] == m["key"])) == 1))
        return _bound(_bound(once, best), lambda found: _bound(F.filter(found, lambda b: b["percentile"] >= STRONG), lambda strong: told(found, strong, foreign)))

    read = F.transform(metrics, lambda m: F.struct(F.lower(F.trim(m["key"])).alias("key"), m["percentile"].alias("percentile"), m["source"].alias("source")))
    return _bound(read, judged)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is worked out once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of(metrics: Column, keys: tuple[str, ...]) -> Column:
    return F.filter(metrics, lambda m: m["key"].isin(*keys))


#: The note of each registered warning, and the order of notes.
WARNING_NOTES = {
    "two_way_target_not_preregistered_forecast_withheld": "two_way_model_scope",
    "partial_only_unvalidated_forecast_withheld": "rookie_model_pending",
    "broad_role_switch_target_not_supported_forecast_withheld": "role_transition_model_scope",
    "current_role_transition_forecast_withheld": "role_transition_model_scope",
    "synthetic_hall_standard_forecast_withheld": "hall_standard_model_scope",
    "bridge_debut_age_outside_supported_range_forecast_withheld": "debut_age_model_scope",
    "bridge_debut_age_cell_missing_forecast_withheld": "debut_age_model_scope",
    "young_elite_distribution_gate_failed_forecast_withheld": "young_elite_model_scope",
    "stale_return_feature_state_forecast_withheld": "stale_return_features",
    "current_opportunity_unobserved_forecast_withheld": "current_opportunity_missing",
}
NOTE_ORDER = (
    "two_way_model_scope", "role_transition_model_scope", "hall_standard_model_scope", "debut_age_model_scope", "post_debut_minor_assignment", "young_elite_model_scope", "rookie_model_pending", "stale_return_features", "current_opportunity_missing",
    "rookie_prior_unmatched", "identity_link_missing", "forecast_not_available", "forecast_withheld_other",
)


def handling_codes(stage: Column, kind: Column, withheld: Column, has_forecast: Column, warnings: Column, prior_missing: Column, id_missing: Column) -> Column:
    """The notes that a record needs, in the order of their priority, each once, joined by
    commas; none for a standard one. ``warnings`` is the forecast's array: each registered one
    gives its note, and a withheld forecast with any of them is not one withheld for other reasons."""
    noted = F.coalesce(F.transform(warnings, lambda w: _looked_up(WARNING_NOTES, w)), F.array().cast("array<string>"))
    registered = F.exists(noted, lambda n: n.isNotNull())
    two_way = kind == "Two-way"
    late = ~stage.isin("pre_debut", "post_debut_minors", "inactive")
    other = withheld & ~registered & ~two_way
    own = {
        "two_way_model_scope": two_way, "post_debut_minor_assignment": stage == "post_debut_minors", "rookie_prior_unmatched": (stage == "recent_callup") & prior_missing, "identity_link_missing": id_missing,
        "forecast_withheld_other": other, "forecast_not_available": ~has_forecast & late & ~other,
    }
    needed = lambda code: F.coalesce(own[code], F.lit(False)) if code in own else F.lit(False)
    told = [F.when(F.array_contains(F.array_compact(noted), code) | needed(code), code) for code in NOTE_ORDER]
    return F.array_join(F.array_compact(F.array(*told)), ",")


def trajectory_state(number: Column, value: Column, trend: Column, exceptional: Column, expected: Column, launch_high: float, launch_median: float, upper: float, median: float, tolerance: float) -> Column:
    """``breakout, rising, maintaining, plateau, declining`` or ``uncertain``."""
    launch = F.when(value >= launch_high, "breakout").when(value >= launch_median, "rising").otherwise("uncertain")
    out = F.coalesce((exceptional >= 0.5) & (value >= upper) & (trend > expected + tolerance), F.lit(False))
    later = F.when(out, "breakout").when(trend.isNull() | F.isnan(trend), "uncertain").when(trend > expected + tolerance, "rising").when(trend < expected - tolerance, "declining").when(value >= median, "maintaining").otherwise("plateau")
    return F.when(number == 1, launch).otherwise(later)


def chapter(age: Column, number: Column, prime: float, decline: float, late: float) -> Column:
    return F.when(number == 1, "launch").when(age < prime, "development").when(age < decline, "prime_plateau").when(age < late, "decline").otherwise("late_career")
