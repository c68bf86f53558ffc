"""Counts and rates of the sport, as lists of Columns to aggregate and as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the feed: codes of completed games and of games that count for statistics.
COMPLETED_STATES = ("F", "O", "Q", "R")
TRACKED_TYPES = ("R", "F", "D", "L", "W")

#: Events that end a plate appearance, and those that are no at bat or no ball in play.
PLATE_APPEARANCE_EVENTS = "single double triple home_run field_out force_out fielders_choice fielders_choice_out field_error double_play triple_play grounded_into_double_play grounded_into_triple_play strikeout strike_out strikeout_double_play strikeout_triple_play walk intent_walk hit_by_pitch catcher_interf sac_fly sac_fly_double_play sac_bunt sac_bunt_double_play batter_interference fan_interference os_ruling_pending_primary".split()
OTHER_EVENTS = "stolen_base stolen_base_2b stolen_base_3b stolen_base_home caught_stealing caught_stealing_2b caught_stealing_3b caught_stealing_home pickoff_1b pickoff_2b pickoff_3b pickoff_error_1b pickoff_error_2b pickoff_error_3b pickoff_caught_stealing_2b pickoff_caught_stealing_3b pickoff_caught_stealing_home wild_pitch passed_ball balk forced_balk defensive_indiff error other_out other_advance runner_double_play cs_double_play fielder_interference runner_interference os_ruling_pending_prior pitcher_step_off batter_timeout mound_visit no_pitch batter_turn at_bat_start runner_placed pitching_substitution offensive_substitution defensive_substitution defensive_switch umpire_substitution pitcher_switch injury ejection game_advisory".split()
WALKS = ("walk", "intent_walk")
STRIKEOUTS = ("strikeout", "strike_out", "strikeout_double_play", "strikeout_triple_play")
NO_AT_BAT = (*WALKS, "hit_by_pitch", "catcher_interf", "sac_fly", "sac_fly_double_play", "sac_bunt", "sac_bunt_double_play")
NO_BALL_IN_PLAY = (*WALKS, "hit_by_pitch", "catcher_interf", *STRIKEOUTS)
BASES = {"single": 1, "double": 2, "triple": 3, "home_run": 4}


def completed(state: str = "coded_state") -> Column:
    return F.col(state).isin(*COMPLETED_STATES)


def tracked(kind: str = "game_type") -> Column:
    return F.col(kind).isin(*TRACKED_TYPES)


def regular(kind: str = "game_type") -> Column:
    return (F.col(kind) == "R") & completed()


def is_barrel(speed: Column, angle: Column) -> Column:
    """Hard and well-angled contact: the angle window widens with every unit of speed above 98."""
    over = speed - 98
    return (speed >= 98) & angle.between(F.greatest(F.lit(8.0), 26 - over), F.least(F.lit(50.0), 30 + 1.5 * over))


def count_if(name: str, condition: Column) -> Column:
    return F.count_if(condition).alias(name)


def batted_ball_totals() -> list[Column]:
    speed = F.col("launch_speed")
    return [F.count(speed).alias("batted_balls"), count_if("hard_hits", speed >= 95), count_if("barrels", is_barrel(speed, F.col("launch_angle")))]


def batting_totals() -> list[Column]:
    """What ``batting_counts`` needs, as sums that can be added up again."""
    return [*batting_counts()[:-1], F.sum("launch_speed").alias("launch_speed_sum")]


def batted_ball_counts() -> list[Column]:
    return [*batted_ball_totals(), F.avg("launch_speed").alias("exit_velocity")]


def batting_counts() -> list[Column]:
    bases = F.col("bases")
    return [
        F.count("*").alias("plate_appearances"),
        count_if("at_bats", F.col("is_at_bat")),
        count_if("hits", bases > 0),
        F.sum(bases).alias("total_bases"),
        count_if("home_runs", bases == 4),
        count_if("walks", F.col("is_walk")),
        count_if("hit_by_pitch", F.col("event_type") == "hit_by_pitch"),
        count_if("sac_flies", F.col("event_type").like("sac_fly%")),
        count_if("strikeouts", F.col("is_strikeout")),
        *batted_ball_counts(),
    ]


BOX_BATTING = ["plate_appearances", "at_bats", "hits", "total_bases", "home_runs", "walks", "hit_by_pitch", "sac_flies", "strikeouts"]
PITCHING = ["batters_faced", "outs", "runs", "earned_runs", "hits", "walks", "strikeouts"]


def sums(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def swing_decision_counts() -> list[Column]:
    zone, swing, whiff = F.col("is_in_zone"), F.col("is_swing"), F.col("is_whiff")
    return [count_if("out_of_zone_pitches", ~zone), count_if("chases", ~zone & swing), count_if("zone_swings", zone & swing), count_if("zone_contacts", zone & swing & ~whiff)]


def pitch_totals() -> list[Column]:
    return [F.count("*").alias("pitches"), count_if("swings", F.col("is_swing")), count_if("whiffs", F.col("is_whiff")), count_if("called_strikes", F.col("is_called_strike"))]


def pitch_counts() -> list[Column]:
    return [*pitch_totals(), F.avg(F.when(F.col("is_fastball"), F.col("start_speed"))).alias("fastball_velocity")]


def pitch_mix_counts() -> list[Column]:
    return [F.count("*").alias("pitches"), count_if("swings", F.col("is_swing")), count_if("whiffs", F.col("is_whiff")), F.avg("start_speed").alias("velocity")]


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, or null where b is not above 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a.cast("double") / b)


def on_base(hits="hits", walks="walks", hbp="hit_by_pitch", at_bats="at_bats", flies="sac_flies") -> Column:
    c = F.col
    return ratio(c(hits) + c(walks) + c(hbp), c(at_bats) + c(walks) + c(hbp) + c(flies))


def batting_rates(teams: Column | None = None) -> dict[str, Column]:
    """AVG, OBP, SLG, OPS, ISO and rates over counts; a league row's totals are divided by ``teams``."""
    avg, obp, slg = ratio("hits", "at_bats"), on_base(), ratio("total_bases", "at_bats")
    per = lambda c: F.col(c) / teams if teams is not None else F.col(c).cast("double")
    return {
        "pa": per("plate_appearances"), "hr": per("home_runs"), "bb": per("batted_balls"),
        "avg": avg, "obp": obp, "slg": slg, "ops": obp + slg, "iso": slg - avg,
        "strikeout_rate": ratio("strikeouts", "plate_appearances"), "walk_rate": ratio("walks", "plate_appearances"),
        "hard_hit_rate": ratio("hard_hits", "batted_balls"), "barrel_rate": ratio("barrels", "batted_balls"),
    }


def swing_rates() -> dict[str, Column]:
    return {"chase_rate": ratio("chases", "out_of_zone_pitches"), "zone_contact_rate": ratio("zone_contacts", "zone_swings")}


def pitching_rates(teams: Column | None = None) -> dict[str, Column]:
    c = F.col
    per = lambda x: x / teams if teams is not None else x
    return {
        "bf": per(c("batters_faced").cast("double")), "innings": per(c("outs") / 3),
        "era": ratio(27 * c("earned_runs"), "outs"), "ra9": ratio(27 * c("runs"), "outs"), "whip": ratio(3 * (c("hits") + c("walks")), "outs"),
        "strikeout_rate": ratio("strikeouts", "batters_faced"), "walk_rate": ratio("walks", "batters_faced"),
    }


def whiff_rates() -> dict[str, Column]:
    return {"whiff_rate": ratio("whiffs", "swings"), "csw_rate": ratio(F.col("called_strikes") + F.col("whiffs"), "pitches")}


def half_up(x: Column) -> Column:
    """Rounds halves upwards, also below zero."""
    return F.floor(x + 0.5)


def expected_wins(scored: Column, allowed: Column, games: Column, exponent: float = 1.83) -> Column:
    """Pythagorean wins; none where no run was scored."""
    a, b = F.pow(scored.cast("double"), F.lit(exponent)), F.pow(allowed.cast("double"), F.lit(exponent))
    return half_up(F.when(a + b > 0, games * a / (a + b)).otherwise(0.0)).cast("int")


def win_pct(wins: Column, losses: Column) -> Column:
    return F.when(wins + losses > 0, wins.cast("double") / (wins + losses)).otherwise(0.0)


def games_back(leader_wins: Column, leader_losses: Column, wins: Column, losses: Column) -> Column:
    return (leader_wins - wins + losses - leader_losses) / 2


def innings_text(outs: Column) -> Column:
    """Outs as innings with thirds after the point: 10 outs are 3.1."""
    return F.concat(F.floor(outs / 3).cast("string"), F.lit("."), (outs % 3).cast("string"))


def age_on(born: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, born) / 12).cast("int")


def official_date(at: Column) -> Column:
    """The day in US Eastern time."""
    return F.to_date(F.from_utc_timestamp(at, "America/New_York"))


def name_or(name: Column, kind: str, key: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit(f"{kind} "), key.cast("string")))


def range_start(kind: str, day: Column) -> Column:
    """First day of the ranges today, week (7 days), month (30 days) and season (January 1)."""
    return {"today": day, "week": F.date_sub(day, 6), "month": F.date_sub(day, 29), "season": F.make_date(F.year(day), F.lit(1), F.lit(1))}[kind]


def compared(value: Column, benchmark: Column, better: str) -> Column:
    up, down = ("better", "worse") if better == "higher" else ("worse", "better")
    return F.when(value.isNull() | benchmark.isNull(), None).when(value > benchmark, up).when(value < benchmark, down).otherwise("even")


def decision_label(win: Column, loss: Column, save: Column, blown: Column, hold: Column) -> Column:
    return F.coalesce(F.when(win, "W"), F.when(loss, "L"), F.when(save, "S"), F.when(blown, "BS"), F.when(hold, "H"))


def decisions(win: Column, loss: Column, save: Column, hold: Column, blown: Column) -> Column:
    return F.array_compact(F.array(F.when(win, "W"), F.when(loss, "L"), F.when(save, "S"), F.when(hold, "H"), F.when(blown, "BS")))


def pitch_flags() -> dict[str, Column]:
    """Outcome flags of a pitch; unknown inputs give unknown flags.  The call codes and pitch types are fixed values of the feed."""
    call = F.col("call_code")
    return {
        "is_swing": call.isin(*"SWMTFLXDE"), "is_whiff": call.isin(*"SWM"), "is_called_strike": call == "C",
        "is_in_zone": F.col("zone").between(1, 9), "is_fastball": F.col("pitch_type").isin("FF", "SI"),
    }


def pitch_result(in_play: Column, strike: Column) -> Column:
    return F.when(in_play, "in_play").when(strike, "strike").otherwise("ball")


def challenge_result(challenged: Column, overturned: Column) -> Column:
    return F.when(challenged, F.when(overturned, "overturned").otherwise("upheld"))


#: Labels of postseason rounds.
POSTSEASON = {"F": "Wild Card", "D": "Division Series", "L": "LCS", "W": "World Series"}


def postseason_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in POSTSEASON.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def series_label(number: Column, games: Column) -> Column:
    return F.concat(F.lit("Game "), number.cast("string"), F.lit(" · Best of "), games.cast("string"))


#: Events beside pitches that a play-by-play shows.
SHOWN_EVENTS = "offensive_substitution defensive_substitution defensive_switch umpire_substitution stolen_base_2b stolen_base_3b stolen_base_home caught_stealing_2b caught_stealing_3b caught_stealing_home defensive_indiff error pickoff_1b pickoff_2b pickoff_3b pickoff_caught_stealing_2b pickoff_caught_stealing_3b pickoff_caught_stealing_home pickoff_error_1b pickoff_error_2b pickoff_error_3b wild_pitch passed_ball balk runner_placed ejection".split()


def is_shown_event(kind: Column, event_type: Column) -> Column:
    return F.coalesce(kind == "no_pitch", F.lit(False)) | F.coalesce(event_type.isin(*SHOWN_EVENTS), F.lit(False))


def is_doubleheader(flag: Column) -> Column:
    return flag.isin("Y", "S")


def makeup_date(rescheduled_from: Column, day: Column) -> Column:
    return F.when(rescheduled_from != day, rescheduled_from)


def game_status(coded: Column, abstract: Column) -> Column:
    """State of a game by its code, else by its abstract state."""
    return (
        F.when(coded.isin(*COMPLETED_STATES), "final").when(coded.isin("I", "M", "N"), "live").when(coded.isin("S", "P"), "scheduled")
        .when(coded == "D", "postponed").when(coded == "C", "cancelled").when(coded == "U", "suspended")
        .when(coded == "T", F.when(abstract == "Preview", "scheduled").otherwise("suspended"))
        .when(abstract == "Final", "final").when(abstract == "Live", "live").otherwise("scheduled")
    )


def status_note(coded: Column, detailed: Column) -> Column:
    return (
        F.when(coded.isin("P", "I") & detailed.startswith("Delayed"), "Delayed").when((coded == "P") & (detailed == "Warmup"), "Warmup")
        .when(coded.isin("M", "N"), "Review").when(coded.isin("Q", "R"), "Forfeit")
    )


def inning_label(inning: Column, half: Column) -> Column:
    """Top 3, Bot 9, Mid 5, End 2; the half as given if unknown; empty without an inning."""
    low = F.lower(half)
    name = F.when(low == "top", "Top").when(low == "bottom", "Bot").when(low == "middle", "Mid").when(low == "end", "End").otherwise(half)
    return F.when(inning.isNull(), "").otherwise(F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), inning.cast("string"))))


def has_situation(outs: Column) -> Column:
    return F.coalesce(outs < 3, F.lit(False))


def shown_score(status: Column, score: Column) -> Column:
    return F.when(status.isin("live", "final", "suspended"), score)


def scoreboard_bucket(status: Column) -> Column:
    return F.when(status == "live", "live").when(status == "scheduled", "upcoming").otherwise("done")
