"""Plan relations: validation of an inventory as violation rows, expected notes, narrowing.

An inventory is a mapping of relations: chapter, sections, episodes, concepts, people,
claims, motifs (FIXTURES.md gives their columns), each with ``ord``, its place in the
document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as T
from marginalia.functions.unicode import casefold

# Relations, kinds, the author's group, floors by relation, root notes.
RELATIONS = ("chapter", "sections", "episodes", "concepts", "people", "claims", "motifs")
KINDS = ("epistemic", "methodological", "substantive")
AUTHOR = "author"
FLOORS = {
    "sections": "section_notes", "episodes": "case_dossiers", "concepts": "concept_notes", "claims": "claims", "motifs": "motifs",
}
ROOT_NOTES = {
    "overview.md": "scope overview", "reading-guide.md": "reading guide",
    "synthesis/argument-map.md": "argument map", "synthesis/claim-evidence-matrix.md": "claim-evidence matrix",
    "synthesis/motif-matrix.md": "motif matrix", "synthesis/critical-reading.md": "critical reading",
    "synthesis/open-questions.md": "open questions",
}
STEPS = 4


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (F.coalesce(x.cast("string"), F.lit("None")) if isinstance(x, Column) else x for x in parts)])


def _rows(df: DataFrame, rule: int, findings: list[tuple[Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), say) for ok, say in findings]))
    return df.select(F.lit(rule).alias("rule"), F.col("ord"), F.posexplode(found).alias("step", "violation"))


def _whole(spark, rule: int, violation: str) -> DataFrame:
    return spark.createDataFrame([(rule, -1, 0, violation)], "rule int, ord int, step int, violation string")


def several(df: DataFrame, key: str) -> DataFrame:
    """key, n, first, last: values of a key that more than one row has, with their least and greatest ``ord``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last")).filter("n > 1")


def fewer_than(df: DataFrame, key: str, floor: int) -> DataFrame:
    """key, n: values of a key that fewer rows have than the floor."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") < floor)


def repeated(df: DataFrame, key: str, rule: int, say: str) -> DataFrame:
    """Values of a key that occur more than once."""
    twice = several(df, key).withColumnRenamed("last", "ord")
    return twice.select(F.lit(rule).alias("rule"), "ord", F.lit(0).alias("step"), _say(say, F.col(key)).alias("violation"))


def below_floor(df: DataFrame, name: str, minimum: int | None, rule: int) -> DataFrame:
    """A violation if a relation has fewer rows than its floor; no floor, no rule."""
    n = df.agg(F.count("*").alias("n"))
    short = n.filter(F.lit(False) if minimum is None else F.col("n") < minimum)
    say = f"inventory.{name} needs at least {minimum} entries"
    return short.select(F.lit(rule).alias("rule"), F.lit(-1).alias("ord"), F.lit(0).alias("step"), F.lit(say).alias("violation"))


def empty(df: DataFrame, name: str, rule: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(rule).alias("rule"), F.lit(-1).alias("ord"), F.lit(0).alias("step"), F.lit(f"inventory.{name} is empty").alias("violation")
    )


def lists_text(values: Column) -> Column:
    return (F.size(values) > 0) & F.forall(values, T.nonempty)


# What the violations below say.


def violations(inventory: dict[str, DataFrame], scope: list[int], author: str, floors: dict[str, int | None] | None = None) -> DataFrame:
    """rule, ord, step, violation: everything wrong with an inventory, all rules at once."""
    some = next(iter(inventory.values()))
    spark, floors = some.sparkSession, floors or {}
    absent = [r for r in RELATIONS if r not in inventory]
    if absent:
        return _whole(spark, 1, f"inventory is missing {absent}")
    pages = F.array(*map(F.lit, sorted(scope))).cast("array<int>")
    col = F.col
    text = lambda field, say: (T.nonempty(col(field)), say)
    paged = lambda say: (T.valid_pages(col("pdf_pages"), pages), _say(say, " has invalid or out-of-scope pdf_pages") if isinstance(say, str) else _say(*say, " has invalid or out-of-scope pdf_pages"))
    sections, episodes, concepts, people = (inventory[r] for r in ("sections", "episodes", "concepts", "people"))
    out = [
        _rows(inventory["chapter"], 2, [
            (col("number") >= 1, _say("inventory.chapter.number must be a positive integer")),
            text("title", _say("inventory.chapter.title is empty")),
            text("organizing_question", _say("inventory.chapter.organizing_question is empty")),
            (T.is_slug(col("slug"), True), _say("inventory.chapter.slug must look like '01-some-title', got ", col("slug"))),
            ((F.size("argument_steps") >= STEPS) & F.forall("argument_steps", T.nonempty), _say("inventory.chapter.argument_steps needs at least four non-empty steps")),
            (lists_text(col("establishes")), _say("inventory.chapter.establishes must be a non-empty string list")),
            (lists_text(col("leaves_open")), _say("inventory.chapter.leaves_open must be a non-empty string list")),
        ]),
        _rows(sections, 3, [
            (col("order") >= 1, _say("section.order must be a positive integer")),
            (T.is_slug(col("slug"), True), _say("bad section slug ", col("slug"))),
            text("title", _say("section ", col("slug"), " has no title")),
            text("summary", _say("section ", col("slug"), " has no summary")),
            paged(("section ", col("slug"))),
        ]),
        repeated(sections, "order", 3, "duplicate section order "), repeated(sections, "slug", 3, "duplicate section slug "),
        _rows(episodes, 4, [
            (T.is_slug(col("slug")), _say("bad episode slug ", col("slug"))),
            text("title", _say("episode ", col("slug"), ".title is empty")),
            text("summary", _say("episode ", col("slug"), ".summary is empty")),
            text("support", _say("episode ", col("slug"), ".support is empty")),
            paged(("episode ", col("slug"))),
        ]),
        repeated(episodes, "slug", 4, "duplicate episode slug "),
        dangling(episodes, sections).select(
            F.lit(4).alias("rule"), "ord", F.lit(9).alias("step"),
            _say("episode ", col("slug"), ".section_order does not name a surveyed section").alias("violation"),
        ),
        _rows(concepts, 5, [
            (T.is_slug(col("slug")), _say("bad concept slug ", col("slug"))),
            text("title", _say("concept ", col("slug"), ".title is empty")),
            text("summary", _say("concept ", col("slug"), ".summary is empty")),
            (col("kind").isin(*KINDS), _say("concept ", col("slug"), ".kind is invalid")),
            paged(("concept ", col("slug"))),
        ]),
        repeated(concepts, "slug", 5, "duplicate concept slug "),
        concepts.join(episodes.select("slug"), "slug", "left_semi").select(
            F.lit(5).alias("rule"), "ord", F.lit(9).alias("step"), _say("concept slug ", col("slug"), " collides with an episode").alias("violation")
        ),
        uncovered_kinds(concepts).select(
            F.lit(5).alias("rule"), F.lit(-1).alias("ord"), F.lit(99).alias("step"),
            _say("inventory.concepts must cover substantive, methodological, and epistemic kinds").alias("violation"),
        ),
        _rows(people, 6, [
            text("name", _say("person.name is empty")), text("role", _say("person.role is empty")),
            text("caution", _say("person.caution is empty")),
            (T.is_slug(col("group")), _say("bad person group ", col("group"))),
            paged(("person ", col("name"))),
        ]),
        _authors(people, author),
        _rows(inventory["claims"], 7, [text(f, _say(f"claim.{f} is empty")) for f in ("claim", "owner", "evidence", "limit")]),
        _rows(inventory["motifs"], 8, [text("motif", _say("inventory.motifs must be a non-empty string list"))]),
    ]
    for rule, name in enumerate(RELATIONS[1:], start=3):
        out.append(empty(inventory[name], name, rule))
        if name in FLOORS:
            out.append(below_floor(inventory[name], name, floors.get(FLOORS[name]), rule))
    return reduce(DataFrame.unionByName, [d.select("rule", F.col("ord").cast("int").alias("ord"), F.col("step").cast("int").alias("step"), "violation") for d in out])


def dangling(episodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Episodes whose section_order names no section."""
    return episodes.join(sections.select(F.col("order").alias("section_order")), "section_order", "left_anti")


def uncovered_kinds(concepts: DataFrame) -> DataFrame:
    """A row unless the valid kinds present are exactly the three."""
    kinds = F.array(*map(F.lit, KINDS))
    return concepts.agg(F.array_sort(F.collect_set("kind")).alias("kinds")).filter(F.col("kinds") != kinds)


def _authors(people: DataFrame, author: str) -> DataFrame:
    own = people.filter(F.col("group") == AUTHOR).agg(F.count("*").alias("n"), F.min(casefold(T.strip(F.col("name")))).alias("name"))
    say = F.when(F.col("n") != 1, "inventory.people must contain exactly one author").when(
        F.col("name") != author.strip().casefold(), "inventory author does not match the document profile"
    )
    return own.select(F.lit(6).alias("rule"), F.lit(-1).alias("ord"), F.lit(99).alias("step"), say.alias("violation")).filter("violation IS NOT NULL")


def first_violation(found: DataFrame) -> str | None:
    row = found.orderBy("rule", F.col("ord") < 0, "ord", "step", "violation").limit(1).collect()
    return row[0]["violation"] if row else None


def expected_notes(inventory: dict[str, DataFrame], scope_id: str) -> DataFrame:
    """path, reason of every note that the inventory calls for."""
    spark = inventory["chapter"].sparkSession
    fixed = spark.createDataFrame(list(ROOT_NOTES.items()), "path string, reason string")
    note = lambda df, folder, label, key="slug", show="title": df.select(
        F.concat(F.lit(f"{folder}/"), F.col(key), F.lit(".md")).alias("path"), F.concat(F.lit(f"{label}: "), F.col(show)).alias("reason")
    )
    chapter = inventory["chapter"].select(F.concat(F.lit("chapters/"), "slug", F.lit(".md")).alias("path"), F.lit("scope hub").alias("reason"))
    people = inventory["people"]
    author = people.filter(F.col("group") == AUTHOR).select(
        F.concat(F.lit("people/"), T.person_slug(F.col("name"), F.lit(scope_id)), F.lit(".md")).alias("path"),
        F.concat(F.lit("author in scope: "), F.col("name")).alias("reason"),
    )
    groups = people.filter(F.col("group") != AUTHOR).groupBy("group").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("people/"), "group", F.lit(".md")).alias("path"),
        F.concat(F.lit("role roster: "), "group", F.lit(" ("), F.col("n").cast("string"), F.lit(" named)")).alias("reason"),
    )
    return reduce(DataFrame.unionByName, [
        fixed, chapter, note(inventory["sections"], "sections", "section"), note(inventory["episodes"], "cases", "episode"),
        note(inventory["concepts"], "concepts", "concept"), author, groups,
    ])


def missing_notes(inventory: dict[str, DataFrame], scope_id: str, notes: DataFrame) -> DataFrame:
    return expected_notes(inventory, scope_id).join(notes.select("path"), "path", "left_anti")


def role_groups(people: DataFrame) -> DataFrame:
    members = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda m: m["name"])
    return people.groupBy("group").agg(F.min("ord").alias("ord"), members.alias("members"))


def section_parts(sections: DataFrame, episodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """order, episodes, concepts: episodes by order, concepts by a page in common."""
    told = episodes.groupBy(F.col("section_order").alias("order")).agg(F.array_sort(F.collect_list("slug")).alias("episodes"))
    shared = (
        sections.select("order", F.explode("pdf_pages").alias("page"))
        .join(concepts.select(F.col("slug"), F.explode("pdf_pages").alias("page")), "page")
        .groupBy("order").agg(F.array_sort(F.collect_set("slug")).alias("concepts"))
    )
    none = F.array().cast("array<string>")
    return sections.select("order", "slug").join(told, "order", "left").join(shared, "order", "left").withColumns(
        {"episodes": F.coalesce("episodes", none), "concepts": F.coalesce("concepts", none)}
    )


def in_page_range(episodes: DataFrame, first: int, last: int) -> DataFrame:
    return episodes.filter(F.exists("pdf_pages", lambda p: p.between(first, last)))


def narrow(inventory: dict[str, DataFrame], episodes: int = 2, others: int = 4) -> dict[str, DataFrame]:
    """A small inventory of the same shape: one section, its first episodes, a concept per kind."""
    sections = inventory["sections"].orderBy("order").limit(1)
    ranked = inventory["episodes"].join(F.broadcast(sections.select(F.col("order").alias("own"))), F.lit(True), "left").withColumn(
        "match", F.col("section_order") == F.col("own")
    )
    any_match = ranked.agg(F.coalesce(F.bool_or("match"), F.lit(False)).alias("any"))
    chosen = ranked.crossJoin(F.broadcast(any_match)).filter("match OR NOT any").orderBy("ord").limit(episodes)
    per_kind = Window.partitionBy("kind").orderBy("ord")
    people = inventory["people"]
    group = people.filter(F.col("group") != AUTHOR).orderBy("ord").limit(1).select("group")
    rest = people.join(F.broadcast(group), "group", "left_semi").orderBy("ord").limit(others)
    return inventory | {
        "sections": sections,
        "episodes": chosen.select(*inventory["episodes"].columns),
        "concepts": inventory["concepts"].withColumn("rn", F.row_number().over(per_kind)).filter("rn = 1").drop("rn"),
        "people": people.filter(F.col("group") == AUTHOR).unionByName(rest.select(*people.columns)),
    }


def load_inventory(spark, data: dict) -> dict[str, DataFrame]:
    """The relations of a parsed inventory document."""
    shape = {
        "chapter": "number int, slug string, title string, organizing_question string, argument_steps array<string>, establishes array<string>, leaves_open array<string>",
        "sections": "order int, slug string, title string, pdf_pages array<int>, summary string",
        "episodes": "slug string, title string, pdf_pages array<int>, summary string, support string, section_order int",
        "concepts": "slug string, title string, kind string, pdf_pages array<int>, summary string",
        "people": "name string, group string, pdf_pages array<int>, role string, caution string",
        "claims": "claim string, owner string, evidence string, limit string",
        "motifs": "motif string",
    }
    out = {}
    for name, schema in shape.items():
        if name not in data:
            continue
        fields = [f.strip().split(" ")[0] for f in schema.split(", ")]
        items = [data[name]] if name == "chapter" else [{"motif": m} for m in data[name]] if name == "motifs" else data[name]
        strict = lambda v, f: None if isinstance(v, bool) and f in ("number", "order", "section_order") else v
        rows = [tuple([i, *[strict(item.get(f), f) for f in fields]]) for i, item in enumerate(items)]
        out[name] = spark.createDataFrame(rows, f"ord int, {schema}")
    return out
