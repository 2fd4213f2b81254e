"""Evaluation sets: ledgered facts planted into the conversations of a turns table.

Every draw is integer arithmetic on the conversation id, so a set is the same on any
cluster and any partitioning, and one conversation can be rebuilt on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import text as X
from turnloom.operators.prefix import running_index
from turnloom.session import shuffled

CATEGORIES = ["single_hop", "multi_hop", "temporal", "conflict", "distractor",
              "cross_session", "abstention"]
PROJECTS = ["Osprey", "Larch", "Marble", "Saffron", "Tundra", "Velvet", "Willow", "Zephyr",
            "Quarry", "Tansy", "Pumice", "Heron"]
DATABASES = ["Sorrel 4", "Lagoon 9", "Umber 2", "Plover 7", "Thistle 5", "Basalt 3", "Orchid 8", "Pelican 6"]
REGIONS = ["Lisbon", "Osaka", "Nairobi", "Toronto", "Santiago", "Oslo"]
DAYS = ["Friday", "Tuesday", "Sunday", "Wednesday", "Saturday", "Monday"]
TIMES = ["08:15", "11:40", "16:20", "19:05", "22:50"]
PERIODS = ["six weeks", "ten months", "two years", "a decade"]
TOPICS = ["night porter", "harbour pilot", "tree surgeon", "piano tuner", "bee keeper"]
# Upper ends of the length classes, in tokens of the given turns; longer conversations are of the last.
TIERS = [500, 1000, 3000]

# category, fact number, role, type, position, text, subject, value, markers, supersedes, superseded by
PLANS = [
    ("single_hop", 1, "required", "durable", 0.25,
     "All bookings of Project {project} are kept in the {database} database.",
     "bookings of Project {project}", "{database}", "Project {project}|{database}", "", ""),
    ("single_hop", 2, "supporting", "repeated", 0.55,
     "As everybody in Project {project} knows, the bookings are in {database}.",
     "bookings of Project {project}", "{database}", "Project {project}|{database}", "", ""),
    ("multi_hop", 1, "required", "durable", 0.10,
     "Sensor readings of Project {project} are written to the {database} database.",
     "sensor readings of Project {project}", "{database}", "Project {project}|{database}", "", ""),
    ("multi_hop", 2, "required", "durable", 0.70,
     "The machines of Project {project} run in a hall in {region}.",
     "machines of Project {project}", "{region}", "Project {project}|{region}", "", ""),
    ("temporal", 1, "forbidden", "temporal", 0.15,
     "Until last winter the bookings of Project {project} were kept in {database}.",
     "bookings of Project {project}", "{database}", "Project {project}|{database}", "", "fact-2"),
    ("temporal", 2, "required", "temporal", 0.65,
     "Since this spring the bookings of Project {project} are kept in {new_database}.",
     "bookings of Project {project}", "{new_database}", "Project {project}|{new_database}", "fact-1", ""),
    ("conflict", 1, "forbidden", "temporal", 0.20,
     "The repair slot of Project {project} is {old_day} at {old_time}.",
     "repair slot of Project {project}", "{old_day} at {old_time}",
     "Project {project}|{old_day}|{old_time}", "", "fact-2"),
    ("conflict", 2, "required", "correction", 0.75,
     "Correction: the repair slot of Project {project} is {new_day} at {new_time}.",
     "repair slot of Project {project}", "{new_day} at {new_time}",
     "Project {project}|{new_day}|{new_time}", "fact-1", ""),
    ("distractor", 1, "required", "durable", 0.05,
     "All bookings of Project {project} are kept in the {database} database.",
     "bookings of Project {project}", "{database}", "Project {project}|{database}", "", ""),
    ("cross_session", 1, "required", "durable", 0.10,
     "The archive of Project {project} is stored in {region}.",
     "archive of Project {project}", "{region}", "Project {project}|{region}", "", ""),
    ("abstention", 1, "absent", "absent", 0.0, "",
     "the {topic} of Project {project}", "", "", "", ""),
]
# category, question, expected answer, further accepted answers, distractor factor, first distractor number
CONTRACTS = [
    ("single_hop", "Where are the bookings of Project {project} kept?", "{database}", "", 1, 3),
    ("multi_hop", "In which city do the machines run whose sensor readings go to {database}?",
     "{region}", "", 1, 3),
    ("temporal", "Where are the bookings of Project {project} kept nowadays?", "{new_database}", "", 1, 3),
    ("conflict", "When is the repair slot of Project {project}?",
     "{new_day} at {new_time}", "{new_day} {new_time}|{new_day}", 1, 3),
    ("distractor", "Where are the bookings of Project {project} kept?", "{database}", "", 3, 2),
    ("cross_session", "In which city is the archive of Project {project}?", "{region}", "", 1, 2),
    ("abstention", "Who is the {topic} of Project {project}?", "", "", 1, 2),
]
DISTRACTORS = [
    ("All bookings of Project {project} are kept in the {database} database.", "{database}"),
    ("Project {project} keeps its delivery notes for {period}.", "{period}"),
    ("The price lists of Project {project} are stored in {database}.", "{database}"),
    ("Project {project} keeps its visitor book for {period}.", "{period}"),
]
ACKNOWLEDGEMENTS = ["I have written that down.", "That is in my notes now.", "Good, I will remember it.",
                    "Fine, it is on the list.", "All right, it is recorded."]
SESSION_FRACTION = 0.6
SPREAD_LOW, SPREAD_HIGH = 0.05, 0.80

_FACT = ("struct<fact_id:string,text:string,fact_type:string,role:string,position:double,"
         "subject:string,value:string,markers:array<string>,supersedes:string,superseded_by:string>")


def draw(key: Column, salt: int | Column, n: int) -> Column:
    """A repeatable number in [0, n) from an integer key and a salt."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    mixed = (key.cast("long") * 7919 + salt.cast("long") * 104729 + 1299709) % 1000003
    return (mixed * 48271 % 2147483647 % n).cast("int")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def render(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return template


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def task_grid(spark: SparkSession, lengths: list[int], variants: int) -> DataFrame:
    """Categories x lengths x variants with the ids a generated set uses."""
    grid = (
        _small(spark, [(c,) for c in CATEGORIES], "category string")
        .crossJoin(_small(spark, [(n,) for n in lengths], "target_tokens int"))
        .crossJoin(spark.range(variants).select(F.col("id").cast("int").alias("variant")))
    )
    return grid.withColumn(
        "task_id",
        F.concat(F.lit("cr-"), F.replace("category", F.lit("_"), F.lit("-")), F.lit("-"),
                 F.col("target_tokens").cast("string"), F.lit("-"),
                 F.lpad(F.col("variant").cast("string"), 2, "0")),
    )


def distractor_count(target_tokens: Column, factor: Column) -> Column:
    raw = F.bround((1 + F.floor(target_tokens / 3000)) * factor).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(10), raw))


def spread(count: Column, index: Column) -> Column:
    """Even positions over the allowed stretch, as fractions of the transcript."""
    step = (SPREAD_HIGH - SPREAD_LOW) / (count - 1)
    return F.when(count == 1, F.lit(round((SPREAD_LOW + SPREAD_HIGH) / 2, 4))).otherwise(
        F.bround(SPREAD_LOW + index * step, 4)
    )


def entities(task: Column) -> dict[str, Column]:
    db, day, hour = draw(task, 2, len(DATABASES)), draw(task, 4, len(DAYS)), draw(task, 6, len(TIMES))
    return {
        "project": pick(PROJECTS, draw(task, 1, len(PROJECTS))),
        "database": pick(DATABASES, db),
        "new_database": pick(DATABASES, db + 1),
        "region": pick(REGIONS, draw(task, 3, len(REGIONS))),
        "old_day": pick(DAYS, day),
        "new_day": pick(DAYS, day + 1 + draw(task, 5, len(DAYS) - 1)),
        "old_time": pick(TIMES, hour),
        "new_time": pick(TIMES, hour + 1),
        "topic": pick(TOPICS, draw(task, 7, len(TOPICS))),
    }


def answer_variants(value: Column) -> Column:
    """The value, then its first word when that differs."""
    return F.filter(
        F.array_distinct(F.array(value, F.element_at(F.split(value, " "), 1))),
        lambda v: F.length(v) > 0,
    )


def assign_slots(positions: Column, slots: Column) -> Column:
    """Distinct, order-keeping slots for an ascending array of positions."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("taken"))

    def place(acc, position):
        wanted = F.bround(position * slots).cast("int")
        slot = F.least(slots - 1, F.greatest(acc["last"] + 1, wanted)).cast("int")
        return F.struct(slot.alias("last"), F.concat(acc["taken"], F.array(slot)).alias("taken"))

    return F.aggregate(positions, start, place, lambda acc: acc["taken"])


def length_class(tokens: Column) -> Column:
    """The least of TIERS that holds so many tokens, else the last."""
    out = F.lit(TIERS[-1])
    for tier in reversed(TIERS[:-1]):
        out = F.when(tokens <= tier, F.lit(tier)).otherwise(out)
    return out


def plan_tasks(turns: DataFrame) -> DataFrame:
    """One row per conversation: question, contract and the facts to be planted."""
    spark = turns.sparkSession
    sized = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sum(X.estimate_tokens("text")).alias("raw_tokens")
    )
    key = F.col("conv_id")
    named = sized.select(
        "*", pick(CATEGORIES, key % len(CATEGORIES)).alias("category"),
        length_class(F.col("raw_tokens")).alias("length_tier"),
        *[value.alias(name) for name, value in entities(key).items()],
        draw(key, 1, len(PROJECTS)).alias("_p"), draw(key, 2, len(DATABASES)).alias("_d"),
    )
    contracts = F.broadcast(_small(
        spark, CONTRACTS,
        "category string, q string, expected string, extra string, factor int, first_no int"))
    facts = _small(
        spark, PLANS,
        "category string, no int, role string, fact_type string, position double, t string, "
        "s string, v string, m string, supersedes string, superseded_by string")
    plans = F.broadcast(facts.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct(*facts.columns[1:]))).alias("plan")))
    joined = named.join(contracts, "category").join(plans, "category")
    values = {name: F.col(name) for name in entities(key)}
    count = distractor_count(F.col("length_tier"), F.col("factor"))
    count = F.when(F.col("category") == "abstention", F.greatest(F.lit(2), count)).otherwise(count)
    joined = joined.withColumn("n_distractors", F.least(count, F.lit(len(PROJECTS) - 1)))

    def planned(row):
        return F.struct(
            F.concat(F.lit("fact-"), row["no"].cast("string")).alias("fact_id"),
            render(row["t"], **values).alias("text"), row["fact_type"].alias("fact_type"),
            row["role"].alias("role"), row["position"].alias("position"),
            render(row["s"], **values).alias("subject"), render(row["v"], **values).alias("value"),
            F.filter(F.split(render(row["m"], **values), r"\|"), lambda m: F.length(m) > 0)
            .alias("markers"),
            row["supersedes"].alias("supersedes"), row["superseded_by"].alias("superseded_by"))

    def distraction(i):
        project = pick(PROJECTS, F.col("_p") + 1 + i)
        database = pick(DATABASES, F.col("_d") + 2 + i % 6)
        kind = draw(F.col("conv_id"), i + 50, len(DISTRACTORS))
        fill = {"project": project, "database": database, "period": pick(PERIODS, i)}
        marker = F.concat(F.lit("Project "), project)
        return F.struct(
            F.concat(F.lit("fact-"), (F.col("first_no") + i).cast("string")).alias("fact_id"),
            render(pick([d[0] for d in DISTRACTORS], kind), **fill).alias("text"),
            F.lit("irrelevant").alias("fact_type"), F.lit("irrelevant").alias("role"),
            spread(F.col("n_distractors"), i).alias("position"), marker.alias("subject"),
            F.lit("").alias("value"),
            F.array(marker, render(pick([d[1] for d in DISTRACTORS], kind), **fill)).alias("markers"),
            F.lit("").alias("supersedes"), F.lit("").alias("superseded_by"))

    drawn = joined.select(
        "*",
        F.concat(
            F.transform("plan", planned).cast(f"array<{_FACT}>"),
            F.transform(F.sequence(F.lit(0), F.col("n_distractors") - 1), distraction)
            .cast(f"array<{_FACT}>")).alias("_facts"))
    # Facts in speaking order; ledger entries that are never spoken come last.
    ordered = F.array_sort("_facts", lambda a, b: F.coalesce(
        F.nullif((a["role"] == "absent").cast("int") - (b["role"] == "absent").cast("int"), F.lit(0)),
        F.nullif(F.signum(a["position"] - b["position"]).cast("int"), F.lit(0)),
        F.when(a["fact_id"] < b["fact_id"], F.lit(-1)).otherwise(F.lit(1))))
    drawn = drawn.withColumn("_facts", ordered)
    spoken = F.size(F.filter("_facts", lambda f: f["role"] != "absent"))
    drawn = drawn.withColumn("n_facts", spoken)
    slots = assign_slots(
        F.transform(F.filter("_facts", lambda f: f["role"] != "absent"), lambda f: f["position"]),
        (F.col("n_turns") + F.col("n_facts")).cast("int"))
    drawn = drawn.withColumn("_slots", slots)
    facts_placed = F.transform("_facts", lambda f, i: F.struct(
        *[f[n].alias(n) for n in ("fact_id", "text", "fact_type", "role", "subject", "value",
                                  "markers", "supersedes", "superseded_by")],
        F.coalesce(F.get("_slots", i) - i, F.lit(0)).alias("turns_before"),
        F.coalesce(F.get("_slots", i) + i, F.lit(0)).alias("introduced_turn"),
        pick(ACKNOWLEDGEMENTS, draw(F.col("conv_id"), i + 90, len(ACKNOWLEDGEMENTS))).alias("ack"),
        F.lit(0).alias("session_index")))
    ids = lambda role: F.transform(
        F.filter("facts", lambda f: f["role"] == role), lambda f: f["fact_id"])
    expected = render(F.col("expected"), **values)
    return (
        drawn.withColumn("facts", facts_placed)
        .select(
            "conv_id", "category", "length_tier", "n_turns", "raw_tokens", "n_facts", "project",
            render(F.col("q"), **values).alias("question"), expected.alias("expected_answer"),
            F.array_distinct(F.concat(
                answer_variants(expected),
                F.filter(F.split(render(F.col("extra"), **values), r"\|"), lambda v: F.length(v) > 0),
            )).alias("acceptable_answers"),
            F.array_sort(ids("required")).alias("required"),
            F.array_sort(ids("supporting")).alias("supporting"),
            F.array_sort(ids("forbidden")).alias("forbidden"),
            (F.col("category") == "abstention").alias("abstention_expected"),
            F.when(F.col("category") == "cross_session", 2).otherwise(1).alias("session_count"),
            "facts"))


def _spoken(task_facts: str = "facts") -> Column:
    return F.filter(task_facts, lambda f: f["role"] != "absent")


def plant_transcript(turns: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every given turn, in order, with the facts said between them; nothing is cut and nothing filled up."""
    plan = tasks.select("conv_id", "facts")
    # A turn's number is its place, so gaps and other first numbers do no harm.
    turns = running_index(turns, ["conv_id"], "turn", "_place", ["role", "text"]).withColumn("turn", F.col("_place"))
    before = F.filter(_spoken(), lambda f: f["turns_before"] <= F.col("turn"))
    given = turns.join(shuffled(plan), "conv_id").select(
        "conv_id", (F.col("turn") + 2 * F.size(before)).cast("int").alias("pos"),
        F.lower("role").alias("role"), F.col("text").alias("content"), F.lit("").alias("fact_id"))
    spoken = plan.select("conv_id", F.explode(_spoken()).alias("f"))
    said = spoken.select("conv_id", F.col("f.introduced_turn").alias("pos"), F.lit("user").alias("role"),
                         F.col("f.text").alias("content"), F.col("f.fact_id").alias("fact_id"))
    acks = spoken.select("conv_id", (F.col("f.introduced_turn") + 1).alias("pos"),
                         F.lit("assistant").alias("role"), F.col("f.ack").alias("content"),
                         F.lit("").alias("fact_id"))
    return given.unionByName(said).unionByName(acks)


def stamp_sessions(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Second session from the first user message at or after the boundary fraction."""
    shape = (
        messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
        .join(shuffled(tasks.select("conv_id", "session_count")), "conv_id")
        .where("session_count > 1")
        .select("conv_id", "n_messages",
                F.greatest(F.lit(1), F.bround(SESSION_FRACTION * F.col("n_messages")).cast("int"))
                .alias("_from")))
    first = (
        messages.where("role = 'user'").join(shuffled(shape), "conv_id")
        .where("pos >= _from").groupBy("conv_id").agg(F.min("pos").alias("boundary")))
    return messages.join(shuffled(first), "conv_id", "left").select(
        *messages.columns,
        F.when(F.col("pos") >= F.col("boundary"), 1).otherwise(0).alias("session"))


def exploded_facts(tasks: DataFrame) -> DataFrame:
    """Ledger rows; a fact's markers are already in the scorer's normalised space."""
    return tasks.select("conv_id", "category", F.explode("facts").alias("f")).select(
        "conv_id", "category", "f.fact_id", "f.role", "f.fact_type", "f.text", "f.subject",
        "f.value", "f.markers", "f.supersedes", "f.superseded_by",
        F.col("f.introduced_turn"), F.col("f.session_index"))


def accepted_answers(tasks: DataFrame) -> DataFrame:
    """Expected answer, listed variants, then required fact values; distinct, in order."""
    values = F.transform(
        F.filter("facts", lambda f: f["role"] == "required"), lambda f: f["value"])
    return tasks.withColumn("accepted", F.filter(
        F.array_distinct(F.concat(F.array("expected_answer"), F.col("acceptable_answers"), values)),
        lambda v: F.length(v) > 0))


CONTEXT_ROLES = ["required", "supporting", "forbidden"]


def task_issues(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """Every structural problem as a (task, problem) row; an empty frame is a clean set."""
    issue = lambda frame, problem: frame.select("conv_id", problem.alias("problem"))
    facts = tasks.select("conv_id", "abstention_expected", "required", "supporting", "forbidden",
                         F.transform("facts", lambda f: f["fact_id"]).alias("ids"),
                         F.explode("facts").alias("f"))
    known = lambda i: (F.length(i) == 0) | F.array_contains("ids", i)
    repeated = tasks.groupBy("conv_id").count().where("count > 1")
    counts = messages.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_distinct("session").alias("sessions"),
        F.count_if(~F.col("role").isin(*X.CHAT_ROLES)).alias("odd_roles"))
    sized = tasks.join(counts, "conv_id", "left")
    parts = [
        issue(repeated, F.lit("duplicate task id")),
        issue(tasks.where(F.length(F.trim("question")) == 0), F.lit("question is empty")),
        issue(sized.where("n IS NULL"), F.lit("conversation is empty")),
        issue(tasks.where(F.size(F.array_distinct(F.transform("facts", lambda f: f["fact_id"])))
                          != F.size("facts")), F.lit("duplicate fact ids")),
        issue(facts.where((F.col("f.fact_type") != "absent") & (F.size("f.markers") == 0)),
              F.concat(F.lit("no markers: "), F.col("f.fact_id"))),
        issue(facts.where(~known(F.col("f.supersedes")) | ~known(F.col("f.superseded_by"))),
              F.concat(F.lit("unknown related fact: "), F.col("f.fact_id"))),
        issue(tasks.where("abstention_expected AND size(required) > 0"),
              F.lit("an abstention task cannot require evidence")),
        issue(sized.where("odd_roles > 0"), F.lit("unknown role")),
        issue(sized.where("session_count > 1 AND sessions <> session_count"),
              F.lit("session count differs from the transcript")),
    ]
    for role in CONTEXT_ROLES:
        ids = F.array_except(role, F.transform("facts", lambda f: f["fact_id"]))
        parts.append(issue(tasks.where(F.size(ids) > 0), F.lit(f"unknown fact in {role}")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
