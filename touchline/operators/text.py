"""Text: cleaning, header-aware chunks, tags, question parsing, match reports, HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions import vocabulary as words
from touchline.functions.boxes import let

SPACE = r"[\s\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def quoted(parts: list[str]) -> str:
    return "|".join(rf"\Q{p}\E" for p in parts)


def has_any(text: Column, parts: list[str]) -> Column:
    """True when the text holds one of the parts; one pass of one pattern."""
    return text.rlike(quoted(parts))


def first_key(text: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    out = None
    for key, parts in table.items():
        out = F.when(has_any(text, parts), key) if out is None else out.when(has_any(text, parts), key)
    return out.otherwise(F.lit(default))


# ---- cleaning -----------------------------------------------------------------------------------------------

def strip_html(text: Column) -> Column:
    """Drop script, style and frame blocks with their content, then every tag."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|iframe)[^>]*>.*?</\1>", ""), r"<[^>]*>", "")


def drop_promo_lines(text: Column) -> Column:
    pattern = "(?iU)^(" + quoted(words.PROMO_LINES) + r")\b"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~strip(line).rlike(pattern)), "\n")


def normalise_terms(text: Column) -> Column:
    for pattern, term in words.TERMS:
        text = F.regexp_replace(text, "(?iU)" + pattern, term)
    return text


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " "))


def clean(text: Column) -> Column:
    return collapse_space(normalise_terms(drop_promo_lines(strip_html(text))))


def drop_front_matter(text: Column) -> Column:
    """Text after the second ``---`` when the document opens with one."""
    return F.when(text.startswith("---"), F.regexp_replace(text, r"(?s)^---.*?---", "")).otherwise(text)


def title_of(source: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(source, r"\.md", ""), "_", " "))


# ---- chunks -------------------------------------------------------------------------------------------------

CHUNKS = "array<struct<h1: string, h2: string, h3: string, text: string, words: int>>"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != ""))


def _fold_lines(text: Column, title: Column, limit: int, keep_blank: bool, h1_resets: bool) -> Column:
    """Walk the lines of one document; a header or ``limit`` words close a chunk after the line that reaches it."""
    empty = F.array().cast(CHUNKS)
    start = F.struct(title.alias("h1"), F.lit("").alias("h2"), F.lit("").alias("h3"), F.lit(None).cast("string").alias("block"),
                     F.lit(0).alias("words"), empty.alias("done"))

    def closed(s: Column) -> Column:
        body = strip(s["block"])
        chunk = F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), s["h3"].alias("h3"), body.alias("text"), s["words"].alias("words"))
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(s["done"], F.array(chunk))).otherwise(s["done"])

    def state(h1: Column, h2: Column, h3: Column, block: Column, count: Column, done: Column) -> Column:
        return F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), block.alias("block"), count.cast("int").alias("words"), done.alias("done"))

    none, zero, blank = F.lit(None).cast("string"), F.lit(0), F.lit("")

    def step(s: Column, line: Column) -> Column:
        def body(bare: Column) -> Column:
            joined = F.when(s["block"].isNull(), line).otherwise(F.concat(s["block"], F.lit("\n"), line))
            keep = state(s["h1"], s["h2"], s["h3"], joined, s["words"], s["done"]) if keep_blank else s
            grown = state(s["h1"], s["h2"], s["h3"], joined, s["words"] + word_count(bare), s["done"])
            rest = lambda n: strip(F.substring(bare, n, 1 << 30))
            keep2 = (lambda c: blank) if h1_resets else (lambda c: c)
            return (F.when(bare == "", F.when(s["block"].isNotNull(), keep).otherwise(s))
                    .when(bare.startswith("# "), state(rest(3), keep2(s["h2"]), keep2(s["h3"]), none, zero, closed(s)))
                    .when(bare.startswith("## "), state(s["h1"], rest(4), blank, none, zero, closed(s)))
                    .when(bare.startswith("### "), state(s["h1"], s["h2"], rest(5), none, zero, closed(s)))
                    .otherwise(let(grown, lambda g: F.when(g["words"] >= limit, state(g["h1"], g["h2"], g["h3"], none, zero, closed(g))).otherwise(g))))
        return let(strip(line), body)

    return F.aggregate(F.split(text, "\n"), start, step)


def heading(h1: Column, h2: Column, h3: Column) -> Column:
    part = lambda h: F.when(h != "", F.concat(F.lit(" > "), h)).otherwise("")
    return F.concat(F.lit("["), h1, part(h2), part(h3), F.lit("]\n"))


def chunk(documents: DataFrame, limit: int = 350) -> DataFrame:
    """Header-aware chunks of ``documents(doc_id, source, text)``; row by row, without a shuffle."""
    walked = documents.withColumn("_s", _fold_lines(F.col("text"), title_of(F.col("source")), limit, True, True))
    tail = strip(F.col("_s.block"))
    last = F.struct(F.col("_s.h1").alias("h1"), F.col("_s.h2").alias("h2"), F.col("_s.h3").alias("h3"), tail.alias("text"), F.col("_s.words").alias("words"))
    chunks = F.when(F.coalesce(tail, F.lit("")) != "", F.concat("_s.done", F.array(last))).otherwise(F.col("_s.done"))
    return (documents_of(walked).withColumn("_all", chunks).select("*", F.posexplode("_all").alias("chunk_no", "_c")).drop("_all", "_s")
            .select(*[c for c in documents.columns if c != "text"], F.col("chunk_no").cast("long").alias("chunk_no"), F.col("_c.h1").alias("h1"),
                    F.col("_c.h2").alias("h2"), F.col("_c.h3").alias("h3"), F.col("_c.text").alias("body"),
                    F.concat(heading(F.col("_c.h1"), F.col("_c.h2"), F.col("_c.h3")), F.col("_c.text")).alias("text")))


def documents_of(df: DataFrame) -> DataFrame:
    return df.drop("text")


def chunk_short(documents: DataFrame, limit: int = 300, minimum: int = 50) -> DataFrame:
    """Second chunker: blank lines dropped, 300 words, and a tail under 50 words joins the chunk before it."""
    walked = documents.withColumn("_s", _fold_lines(F.col("text"), title_of(F.col("source")), limit, False, False))
    s, done = F.col("_s"), F.col("_s.done")
    tail = F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), s["h3"].alias("h3"), strip(s["block"]).alias("text"), s["words"].alias("words"))
    before = F.element_at(done, -1)
    merged = F.struct(before["h1"].alias("h1"), before["h2"].alias("h2"), before["h3"].alias("h3"),
                      F.concat(before["text"], F.lit("\n"), s["block"]).alias("text"), (before["words"] + s["words"]).alias("words"))
    chunks = (F.when(s["block"].isNull(), done).when(s["words"] >= minimum, F.concat(done, F.array(tail)))
              .when(F.size(done) > 0, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(done))
    return (walked.withColumn("_all", chunks).select(*[c for c in documents.columns if c != "text"], F.posexplode("_all").alias("chunk_no", "_c"))
            .select(*[c for c in documents.columns if c != "text"], F.col("chunk_no").cast("long").alias("chunk_no"),
                    F.concat(heading(F.col("_c.h1"), F.col("_c.h2"), F.col("_c.h3")), F.col("_c.text")).alias("text"), F.col("_c.words").cast("long").alias("words")))


def file_topic(source: Column) -> tuple[Column, Column, Column]:
    """Topic, intent and phase a file name implies."""
    s = F.lower(source)
    topic = (F.when(s.contains("bloc_bas"), "bloc_bas").when(s.contains("pressing"), "pressing").when(has_any(s, ["sortie_balle", "relance"]), "relance")
             .when(s.contains("role"), "roles").when(s.contains("formation"), "formations").when(s.contains("transition"), "transitions")
             .when(s.contains("phase_offensive"), "offensif").when(s.contains("analyse_video"), "video").otherwise("general"))
    defend = has_any(s, ["defend", "repli", "cpa_defensifs"]) | (s.contains("bloc_bas") & ~s.contains("desequilibrer"))
    attack = has_any(s, ["attack", "desequilibrer", "jeu_couloirs", "centres_surface", "fixation_axiale", "sortie_balle", "relance", "jeu_direct"])
    change = has_any(s, ["transition", "pressing"])
    intent = (F.when(defend, "defend").when(attack, "attack").when(change, "transition").when(s.contains("roles"), "roles")
              .when(s.contains("formation"), "formations").otherwise("general"))
    phase = F.when(defend, "defensive").when(attack, "offensive").when(change, "transition").otherwise("general")
    return topic, intent, phase


# ---- tags ---------------------------------------------------------------------------------------------------

def team_tags(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?iU)\b\Q{n}\E\b"), n) for n in words.TEAM_NAMES]))


def tactical_tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(has_any(low, parts), tag) for tag, parts in words.TAG_WORDS.items()]))


def chunk_type(body: Column, h1: Column, h2: Column) -> Column:
    return first_key(F.lower(F.concat_ws(" ", h1, h2, body)), words.TYPE_WORDS, "general")


def half_of(minute: Column) -> Column:
    return F.when(minute <= 45, "1MT").otherwise("2MT")


def interval_of(minute: Column) -> Column:
    out = F.when(minute <= 15, "0-15")
    for low, high in ((15, 30), (30, 45), (45, 60), (60, 75), (75, 90)):
        out = out.when(minute <= high, f"{low}-{high}")
    return out.otherwise("90+")


def time_tags(text: Column, source: Column) -> tuple[Column, Column]:
    """Period and interval: an explicit comment first, else, in match reports, the first minute named."""
    comment = r"<!--\s*@time:\s*periode=(\w+),\s*intervalle=([\w+-]+)\s*-->"
    period, interval = F.regexp_extract(text, comment, 1), F.regexp_extract(text, comment, 2)
    minute = F.regexp_extract(text, r"(?i)\b(\d{1,3})(?:e|ème)?\s*(?:minute|min|')", 1)
    named = source.startswith("match_") & (minute != "")
    at = minute.try_cast("int")
    return (F.when(period != "", period).when(named, half_of(at)).otherwise("global"),
            F.when(period != "", interval).when(named, interval_of(at)).otherwise("all"))


def tag_chunks(chunks: DataFrame) -> DataFrame:
    period, interval = time_tags(F.col("text"), F.col("source"))
    return (chunks.withColumn("teams", team_tags(F.col("text"))).withColumn("tags", tactical_tags(F.col("text")))
            .withColumn("type", chunk_type(F.col("body"), F.col("h1"), F.col("h2"))).withColumn("period", period).withColumn("interval", interval))


# ---- questions ----------------------------------------------------------------------------------------------

def targets(query: Column) -> tuple[Column, Column, Column]:
    """Team file parts (distinct), first competition, players named in a question."""
    low = F.lower(query)
    empty = F.array().cast("array<string>")
    parts = [F.when(low.contains(a), F.array(*[F.lit(s) for s in slugs])).otherwise(empty) for a, slugs in words.TEAM_ALIASES.items() if slugs]
    players = F.array_compact(F.array(*[F.when(low.contains(a), a) for a, slugs in words.TEAM_ALIASES.items() if not slugs]))
    competition = None
    for name, code in words.COMPETITIONS.items():
        competition = F.when(low.contains(name), code) if competition is None else competition.when(low.contains(name), code)
    return F.array_distinct(F.concat(*parts)), competition, players


def expand(queries: DataFrame) -> DataFrame:
    """Up to three distinct wordings, and the period and interval a question points to."""
    low = F.lower("query")
    stated = F.when(has_any(low, words.FIRST_HALF), "1MT").when(has_any(low, words.SECOND_HALF), "2MT").when(low.contains("prolongation"), "prolongations")
    minute = F.regexp_extract(low, r"\b(\d{1,3})(?:e|ème)?\s*(?:minute|min|'|è)", 1)
    at, named = minute.try_cast("int"), minute != ""
    period = F.coalesce(stated, F.when(named, half_of(at)).when(has_any(low, words.OPENING), "1MT").when(has_any(low, words.CLOSING), "2MT"), F.lit("global"))
    interval = F.when(named, interval_of(at)).when(has_any(low, words.OPENING), "0-15").when(has_any(low, words.CLOSING), "60-75").otherwise("all")
    found = lambda parts: F.array_compact(F.array(*[F.when(low.contains(p), p) for p in parts]))
    keys, teams = found(words.EXPANSION_WORDS), found(words.EXPANSION_TEAMS)
    middle = (F.when((F.size(teams) > 0) & (F.size(keys) > 0), F.concat(F.array_join(teams, " "), F.lit(" "), F.array_join(keys, " ")))
              .when(F.size(keys) > 0, F.concat(F.element_at(keys, 1), F.lit(" tactique"))))
    wordings = F.array_compact(F.array(F.col("query"), middle, F.concat(F.col("query"), F.lit(" tactique football"))))
    distinct = F.aggregate(wordings, F.array().cast("array<string>"), lambda acc, w: F.when(
        F.exists(acc, lambda a: F.lower(a) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return queries.select("*", F.slice(distinct, 1, 3).alias("variations"), period.alias("period"), interval.alias("interval"))


def classify(questions: DataFrame, in_video: bool = False) -> DataFrame:
    """Type, scope, intent, phase, time, team and entities of each question."""
    q = F.lower(strip(F.col("query")))
    number = r"(\d+(?:\.\d+)?)\s*(?:s|sec|secondes?)"
    span = r"(?:entre|de)\s*(\d+(?:\.\d+)?)\s*(?:s|sec|secondes?)?\s*(?:et|à)\s*(\d+(?:\.\d+)?)"
    num = lambda pattern, group=1: F.regexp_extract(q, pattern, group).try_cast("double")
    t0, t1 = num(span), num(span, 2)
    after = num(r"(\d+(?:\.\d+)?)\s*(?:s|sec|secondes?)\s*(?:suivant|après|apres)")
    before = num(r"(\d+(?:\.\d+)?)\s*(?:s|sec|secondes?)\s*(?:précédant|precedant|avant)")
    at = F.when(t0.isNull(), num(number + r"\b"))
    frame = F.regexp_extract(q, r"(?:frame|image|trame)\s*(\d+)", 1).try_cast("bigint")
    team = (F.when(q.rlike(r"(?U)\b(équipe\s*0|equipe\s*0|team\s*0)\b"), "TEAM_0").when(q.rlike(r"(?U)\b(équipe\s*1|equipe\s*1|team\s*1)\b"), "TEAM_1"))
    df = questions.select("*", q.alias("_q"), at.alias("at_s"), F.least(t0, t1).alias("from_s"), F.greatest(t0, t1).alias("to_s"), frame.alias("at_frame"),
                          F.coalesce(before, after).alias("window_s"), F.when(before.isNotNull(), "before").when(after.isNotNull(), "after").alias("direction"),
                          team.alias("team"))
    q = F.col("_q")
    timed = F.col("at_s").isNotNull() | F.col("from_s").isNotNull()
    fixed = timed | F.col("at_frame").isNotNull() | F.col("team").isNotNull()
    video = F.lit(in_video) | fixed | has_any(q, words.VIDEO_WORDS)
    greeting = q.rlike("(?U)" + "|".join(words.GREETINGS)) & F.lit(not in_video)
    off_topic = q.rlike(r"(?U)\b(" + "|".join(words.OFF_TOPIC) + r")\b")
    barred = q.rlike("(?U)" + "|".join(words.UNSUPPORTED))
    theory = has_any(q, words.THEORY) & ~(fixed | has_any(q, words.ANCHORS))
    scope = (F.when(~video | theory, "GENERAL_FOOTBALL").when(has_any(q, words.COMPARISON), "MATCH_COMPARISON").when(has_any(q, words.EXPLANATION), "MATCH_EXPLANATION")
             .when(has_any(q, words.TIMELINE) | timed, "MATCH_TIMELINE").otherwise("MATCH_FACT"))
    scope = F.when(greeting, "GENERAL_FOOTBALL").when(off_topic | barred, "UNSUPPORTED").otherwise(scope)
    kind = (F.when(greeting, "greeting").when(off_topic, "out_of_scope").when(barred, "unsupported_metric"))
    plain = greeting | off_topic | barred
    intents = (F.when(has_any(q, words.INTENTS["defend"]), "defend").when(has_any(q, words.INTENTS["attack"]), "attack")
               .when(has_any(q, words.INTENTS["formations"]), "formations").when(has_any(q, words.INTENTS["roles"]), "roles").otherwise("general"))
    phases = (F.when(has_any(q, words.PHASES["transition"]), "transition").when(has_any(q, words.PHASES["defensive"]), "defensive")
              .when(has_any(q, words.PHASES["offensive"]), "offensive").otherwise("general"))
    formation = None
    for name in words.FORMATION_NAMES:
        formation = F.when(q.rlike(rf"\b{name}\b"), name) if formation is None else formation.when(q.rlike(rf"\b{name}\b"), name)
    for name in words.FORMATION_NAMES:
        formation = formation.when(q.rlike(rf"\b{name.replace('-', '')}\b"), name)
    df = df.withColumn("scope", scope)
    return df.select(
        *questions.columns, F.coalesce(kind, F.when(video & (F.col("scope") != "GENERAL_FOOTBALL"), "video_tactical_query").otherwise("tactical_question")).alias("type"),
        "scope", F.when(plain, "general").otherwise(intents).alias("intent"), F.when(plain, "general").otherwise(phases).alias("phase"),
        "at_s", "from_s", "to_s", "at_frame", "direction", "window_s", "team", formation.alias("formation"), first_key(q, words.PROBLEMS).alias("problem"),
        first_key(q, words.GAME_PHASES).alias("game_phase"), first_key(q, words.GOALS).alias("goal"))


# ---- match reports and tables -------------------------------------------------------------------------------

def _default_stats() -> Column:
    return F.struct(F.lit(50).alias("possession_pct"), F.lit(400).alias("passes_completed"), F.lit(30).alias("passes_progressive"), F.lit(10).alias("shots"),
                    F.lit(4).alias("shots_on_target"), F.lit(1.0).alias("xg"), F.lit(10.0).alias("ppda"), F.lit("medium-block").alias("bloc_style"))


def parse_match_report(reports: DataFrame) -> DataFrame:
    """Semi-structured report lines into meta fields, a map of team statistics and an array of events."""
    lines = F.transform(F.split("text", "\n"), strip)
    first = lambda prefix: F.try_element_at(F.filter("_lines", lambda l: l.startswith(prefix)), F.lit(-1))
    df = reports.withColumn("_lines", lines)
    pick = lambda line, pattern, group=1: F.regexp_extract(F.coalesce(line, F.lit("")), pattern, group)
    match = r"Match:\s*([A-Za-z0-9\s]+)\s+vs\s+([A-Za-z0-9\s]+)"
    or_else = lambda value, default: F.when(value != "", strip(value)).otherwise(default)
    df = df.select(
        "*", or_else(pick(first("Match:"), match), "PSG").alias("home"), or_else(pick(first("Match:"), match, 2), "OM").alias("away"),
        F.coalesce(pick(first("Score:"), r"Score:\s*(\d+)-(\d+)").try_cast("int"), F.lit(0)).alias("score_home"),
        F.coalesce(pick(first("Score:"), r"Score:\s*(\d+)-(\d+)", 2).try_cast("int"), F.lit(0)).alias("score_away"),
        or_else(pick(first("Date:"), r"Date:\s*([\d-]+)"), "2026-06-09").alias("date"),
        F.coalesce(strip(F.regexp_replace(first("Competition:"), "Competition:", "")), F.lit("Ligue 1")).alias("competition"),
        F.coalesce(strip(F.regexp_replace(first("Saison:"), "Saison:", "")), F.lit("2025-2026")).alias("season"))
    number = lambda body, pattern, kind, default: F.coalesce(F.regexp_extract(body, pattern, 1).try_cast(kind), F.lit(default).cast(kind)).alias

    def stats(body: Column) -> Column:
        return F.struct(number(body, r"Possession\s*(\d+)%", "int", 50)("possession_pct"), number(body, r"Passes\s*(\d+)", "int", 400)("passes_completed"),
                        number(body, r"Passes progressives\s*(\d+)", "int", 30)("passes_progressive"), number(body, r"Tirs\s*(\d+)", "int", 10)("shots"),
                        number(body, r"Tirs cadrés\s*(\d+)", "int", 4)("shots_on_target"), number(body, r"xG\s*([\d.]+)", "double", 1.0)("xg"),
                        number(body, r"PPDA\s*([\d.]+)", "double", 10.0)("ppda"),
                        F.when(F.regexp_extract(body, r"Bloc style\s*(\S+)", 1) != "", F.regexp_extract(body, r"Bloc style\s*(\S+)", 1))
                        .otherwise("medium-block").alias("bloc_style"))

    is_meta = lambda l: l.rlike("^(Match:|Score:|Date:|Competition:|Saison:)")
    stat_lines = F.filter("_lines", lambda l: ~is_meta(l) & l.contains(":") & l.rlike("Possession|Passes"))
    df = df.withColumn("_named", F.transform(stat_lines, lambda l: F.struct(
        strip(F.substring_index(l, ":", 1)).alias("key"), stats(F.regexp_extract(l, r"(?s)^[^:]*:(.*)$", 1)).alias("value"))))
    # the last line of a team wins; teams without a line take the defaults
    missing = F.transform(F.array_except(F.array("home", "away"), F.col("_named.key")), lambda t: F.struct(t.alias("key"), _default_stats().alias("value")))
    last_of = F.filter("_named", lambda e, i: ~F.exists(F.slice("_named", i + 2, F.size("_named")), lambda later: later["key"] == e["key"]))
    event = r"-\s*(\d+)(?:ème|e)?\s*minute:\s*\((\w+)\)\s*(.*)"
    event_lines = F.filter("_lines", lambda l: l.startswith("-") & l.contains("minute") & l.rlike(event) & ~(l.contains(":") & l.rlike("Possession|Passes")))

    def as_event(l: Column) -> Column:
        text = strip(F.regexp_extract(l, event, 3))
        kind = F.when(text.rlike("But|but"), "goal").when(text.rlike("Transition|transition|contre-attaque"), "big_chance").otherwise("tactical_change")
        return F.struct(F.regexp_extract(l, event, 1).cast("int").alias("minute"), F.regexp_extract(l, event, 2).alias("team"), kind.alias("type"), text.alias("description"))

    slug = lambda c: F.regexp_replace(F.lower(c), " ", "_")
    df = df.withColumn("match_id", F.concat(F.regexp_replace("date", "-", "_"), F.lit("_"), slug(F.col("home")), F.lit("_"), slug(F.col("away")), F.lit("_01")))
    return df.withColumn("team_stats", F.map_from_entries(F.concat(last_of, missing))).withColumn("events", F.transform(event_lines, as_event)).drop("_lines", "_named", "text")


def render_match(matches: DataFrame) -> DataFrame:
    """Markdown report of parsed matches: numbers in fixed sentences, one section per event."""
    h, a = F.col("team_stats")[F.col("home")], F.col("team_stats")[F.col("away")]
    build = F.format_string("Le %s a complété %d passes dont %d progressives; l'%s %d dont %d.", "home", h["passes_completed"], h["passes_progressive"], "away",
                            a["passes_completed"], a["passes_progressive"])
    attack = F.format_string("Le %s: %d tirs, %d cadrés, %.2f xG; l'%s: %d tirs, %d cadrés, %.2f xG.", "home", h["shots"], h["shots_on_target"], h["xg"], "away",
                             a["shots"], a["shots_on_target"], a["xg"])
    defend = F.format_string("Le %s en %s (PPDA %.1f); l'%s en %s (PPDA %.1f).", "home", h["bloc_style"], h["ppda"], "away", a["bloc_style"], a["ppda"])
    event = lambda e: F.concat(F.lit("### Événement : "), e["minute"].cast("string"), F.lit("ème minute\n"), e["description"], F.lit(" <!-- @time: periode="),
                               half_of(e["minute"]), F.lit(", intervalle="), interval_of(e["minute"]), F.lit(" -->"))
    title = F.format_string("# Match: %s vs %s (%d - %d)", "home", "away", "score_home", "score_away")
    body = F.concat_ws("\n\n", title, F.concat(F.lit("## Construction & Sortie\n"), build), F.concat(F.lit("## Organisation Offensive\n"), attack),
                       F.concat(F.lit("## Organisation Défensive\n"), defend), F.lit("## Analyse Chronologique des Événements"),
                       F.array_join(F.transform("events", event), "\n\n"))
    return matches.withColumn("markdown", body)


STAT_FIELDS = {"minutes_played": ("Min", "int", 0), "goals": ("Gls", "int", 0), "expected_goals": ("xG", "double", 0.0), "expected_assists": ("xA", "double", 0.0),
               "key_passes": ("KP", "int", 0), "progressive_dribbles": ("Prog", "int", 0), "defensive_pressures": ("Press", "int", 0)}


def html_stat_rows(pages: DataFrame) -> DataFrame:
    """Player rows of the first table of each page; header and total rows are skipped, missing columns take defaults."""
    table = F.regexp_extract("html", r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: strip(strip_html(c)))
    df = pages.withColumn("_rows", F.transform(rows, cells))
    header = F.try_element_at(F.filter("_rows", lambda r: F.array_contains(r, "Player")), F.lit(1))
    df = df.withColumn("_head", header).filter("_head IS NOT NULL").withColumn("_cells", F.explode("_rows"))
    value = lambda name: F.when(F.array_position("_head", F.lit(name)) > 0, F.get("_cells", (F.array_position("_head", F.lit(name)) - 1).cast("int")))
    player = value("Player")
    return (df.filter(player.isNotNull() & (player != "") & ~player.isin("Player", "Squad Totals"))
            .select(*[c for c in pages.columns if c != "html"], player.alias("player_name"),
                    *[F.coalesce(value(c).try_cast(kind), F.lit(default)).alias(name) for name, (c, kind, default) in STAT_FIELDS.items()]))
