"""Duplicate people and collapsed partnerships.

Two records in a block may be one person unless they conflict: their first
names disagree, or they entered one tournament with different partners. The
records that may be joined are nearly all of a block, so pairs that *agree*
are never listed. A component grows from one record, and a record joins it
unless it conflicts with every member, which counts per tournament decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdikt.functions.text import letters
from verdikt.operators.graph import connected_components
from verdikt.operators.lineage import cut_lineage


def appearances(entry_debaters: DataFrame, entry_tournaments: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct (debater, tournament, partner-surname signature)."""
    surname = people.select("debater_id", F.coalesce(F.nullif(letters("last"), F.lit("")), "debater_id")
                            .alias("surname"))
    links = entry_debaters.select("entry_id", "debater_id").distinct().join(
        surname, "debater_id", "left").withColumn("surname", F.coalesce("surname", "debater_id"))
    team = links.groupBy("entry_id").agg(F.collect_list(F.struct("debater_id", "surname")).alias("team"))
    each = team.select("entry_id", "team", F.explode("team").alias("me"))
    partners = F.transform(F.filter("team", lambda p: p["debater_id"] != F.col("me.debater_id")),
                           lambda p: p["surname"])
    return (each.select("entry_id", F.col("me.debater_id").alias("debater_id"),
                        F.array_join(F.array_sort(partners), "+").alias("signature"))
            .join(entry_tournaments.select("entry_id", "tournament_id"), "entry_id")
            .select("debater_id", "tournament_id", "signature").distinct())


def blocking_keys(people: DataFrame) -> DataFrame:
    """(key, debater): full name anywhere, surname at a school, joined name at a school."""
    first, last = letters("first"), letters("last")
    school = F.when(F.coalesce("school_id", F.lit("")) != "", F.col("school_id"))
    at_school = lambda word: F.when(last != "", F.concat(F.lit("school|"), school, F.lit("|"), word))
    keys = F.array(F.when((first != "") & (last != ""), F.concat(F.lit("name|"), first, last)),
                   at_school(last), at_school(F.concat(first, last)))
    return (people.select("debater_id", first.alias("first"),
                          F.explode(F.array_distinct(F.array_compact(keys))).alias("key")))


def _classes(seen: DataFrame) -> DataFrame:
    """One row per (debater, tournament): records agree there only if ``side`` is equal.

    More than one signature at a tournament agrees with nobody, so it is named
    after the record itself.
    """
    return (seen.groupBy("debater_id", "tournament_id")
            .agg(F.count("*").alias("n"), F.min("signature").alias("signature"))
            .select("debater_id", "tournament_id",
                    F.when(F.col("n") == 1, F.concat(F.lit("s:"), "signature"))
                    .otherwise(F.concat(F.lit("m:"), "debater_id")).alias("side")))


def _fold_copies(keyed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of a block with one name and one history agree; keep one and link the rest to it."""
    history = (classes.groupBy("debater_id")
               .agg(F.sha2(F.array_join(F.array_sort(F.collect_list(
                   F.concat_ws("\x1f", "tournament_id", "side"))), "\x1e"), 256).alias("history")))
    marked = keyed.join(history, "debater_id", "left").fillna("", ["history"])
    kept = marked.groupBy("key", "first", "history").agg(F.min("debater_id").alias("kept"))
    links = (marked.join(kept, ["key", "first", "history"]).where("debater_id <> kept")
             .select(F.col("debater_id").alias("src"), F.col("kept").alias("dst")).distinct())
    return kept.select("key", "first", F.col("kept").alias("debater_id")), links


def ambiguity_guard(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks where two *named* records conflict, found without pairing them.

    Names agree when all are prefixes of the longest. Histories disagree when
    one tournament has two records and two partner signatures.
    """
    named = keyed.where("first <> ''")
    longest = named.groupBy("key").agg(F.max_by("first", F.struct(F.length("first"), "first")).alias("longest"))
    by_name = (named.select("key", "first").distinct().join(longest, "key")
               .where(~F.startswith(F.col("longest"), F.col("first"))).select("key"))
    by_history = (named.join(classes, "debater_id").groupBy("key", "tournament_id")
                  .agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
                  .where("n > 1 and lo <> hi").select("key"))
    return by_name.union(by_history).distinct()


def _sub_blocks(keyed: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Blocks in which every pair of names agrees: (block, debater)."""
    plain = keyed.join(ambiguous, "key", "left_anti").select(F.col("key").alias("block"), "debater_id")
    split = keyed.join(ambiguous, "key", "left_semi").where("first <> ''")
    tag = lambda *c: F.concat_ws("\x1f", "key", *c).alias("block")
    own = split.select(tag("first"), "debater_id")
    names = split.select("key", "first").distinct()
    prefix = F.explode(F.when(F.length("first") > 1, F.transform(
        F.sequence(F.lit(1), F.length("first") - 1), lambda i: F.substr(F.col("first"), F.lit(1), i)))
        .otherwise(F.array().cast("array<string>")))
    related = (names.select("key", F.col("first").alias("long"), prefix.alias("short"))
               .join(names.withColumnRenamed("first", "short"), ["key", "short"]))
    both = related.select("key", "short", "long", F.explode(F.array("short", "long")).alias("first"))
    crossed = split.join(both, ["key", "first"]).select(tag("short", "long"), "debater_id")
    return plain.union(own).union(crossed)


def conflicts(occurrences: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Conflicting (block, debater, other) between two sets of records of the same blocks."""
    a = occurrences.join(left, ["block", "debater_id"], "left_semi")
    b = (occurrences.join(right, ["block", "debater_id"], "left_semi")
         .select("block", "tournament_id", F.col("debater_id").alias("other"), F.col("side").alias("theirs")))
    return (a.join(b, ["block", "tournament_id"]).where("side <> theirs")
            .select("block", "debater_id", "other").distinct())


def grow_components(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(block, debater, component): components of "does not conflict" inside each block."""
    sized = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    busy = classes.groupBy("debater_id").agg(F.count("*").alias("busy"))
    open_ = cut_lineage(blocks.join(sized, "block", "left_semi").join(busy, "debater_id", "left")
                        .fillna(0, ["busy"]))
    occ = cut_lineage(open_.select("block", "debater_id").join(classes, "debater_id"))
    seed = F.min_by("debater_id", F.struct("busy", "debater_id"))
    grown = cut_lineage(open_.groupBy("block").agg(seed.alias("debater_id"))
                        .withColumn("component", F.col("debater_id")))
    active = grown.select("block", "component")
    while True:
        waiting = open_.join(grown, ["block", "debater_id"], "left_anti")
        members = grown.join(active, ["block", "component"], "left_semi")
        size = members.groupBy("block").agg(F.count("*").alias("size"))
        at = occ.join(members.select("block", "debater_id"), ["block", "debater_id"], "left_semi")
        per_side = at.groupBy("block", "tournament_id", "side").agg(F.count("*").alias("n_side"))
        per_day = per_side.groupBy("block", "tournament_id").agg(F.sum("n_side").alias("n_day"))
        bound = (occ.join(waiting, ["block", "debater_id"], "left_semi")
                 .join(per_day, ["block", "tournament_id"])
                 .join(per_side, ["block", "tournament_id", "side"], "left")
                 .groupBy("block", "debater_id")
                 .agg(F.sum(F.col("n_day") - F.coalesce("n_side", F.lit(0))).alias("most"),
                      F.count("*").alias("shared")))
        judged = cut_lineage(waiting.select("block", "debater_id", "busy").join(size, "block")
                             .join(bound, ["block", "debater_id"], "left").fillna(0, ["most", "shared"]))
        # The count is exact over one shared tournament and an upper bound over several.
        unsure = judged.where("most >= size and shared > 1").select("block", "debater_id", "size")
        exact = (conflicts(occ, unsure, members).groupBy("block", "debater_id")
                 .agg(F.count("*").alias("exact")))
        joins = (judged.where("most < size").select("block", "debater_id")
                 .union(unsure.join(exact, ["block", "debater_id"]).where("exact < size")
                        .select("block", "debater_id")))
        newly = cut_lineage(joins.join(active, "block"))
        stuck = active.join(newly.select("block").distinct(), "block", "left_anti")
        left = waiting.join(newly.select("block", "debater_id"), ["block", "debater_id"], "left_anti")
        fresh = cut_lineage(left.join(stuck.select("block"), "block", "left_semi").groupBy("block")
                            .agg(seed.alias("debater_id")).withColumn("component", F.col("debater_id")))
        if newly.isEmpty() and fresh.isEmpty():
            break
        grown = cut_lineage(grown.unionByName(newly).unionByName(fresh))
        active = cut_lineage(active.join(newly.select("block").distinct(), "block", "left_semi")
                             .unionByName(fresh.select("block", "component")))
    return grown


def same_person_links(people: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges ``src dst`` whose components are people."""
    classes = cut_lineage(_classes(seen))
    keyed, copies = _fold_copies(blocking_keys(people), classes)
    keyed, copies = cut_lineage(keyed), cut_lineage(copies)
    ambiguous = cut_lineage(ambiguity_guard(keyed, classes))
    grown = grow_components(_sub_blocks(keyed, ambiguous).distinct(), classes)
    return (grown.select(F.col("debater_id").alias("src"), F.col("component").alias("dst"))
            .where("src <> dst").union(_kept_copies(copies, people, ambiguous))).distinct()


def _kept_copies(copies: DataFrame, people: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Copy links some shared block supports: unnamed copies are linked to nobody in an
    ambiguous one."""
    keyed = blocking_keys(people)
    ok = (keyed.join(ambiguous.withColumn("amb", F.lit(True)), "key", "left")
          .where("first <> '' or amb is null").select("key", "debater_id"))
    a, b = ok.withColumnRenamed("debater_id", "src"), ok.withColumnRenamed("debater_id", "dst")
    return copies.join(a, "src").join(b, ["dst", "key"], "left_semi").select("src", "dst")


def elect_canonical(components: DataFrame, people: DataFrame, seen: DataFrame,
                    members: DataFrame) -> DataFrame:
    """debater -> canonical: a member school, then a real id, then most tournaments, then the id."""
    busy = seen.select("debater_id", "tournament_id").distinct().groupBy("debater_id").agg(
        F.count("*").alias("busy"))
    known = (people.select("debater_id", "school_id")
             .join(members.select("school_id", F.lit(1).alias("member")), "school_id", "left")
             .join(busy, "debater_id", "left").fillna(0, ["member", "busy"]))
    order = F.struct((-F.col("member")).alias("m"), F.startswith("debater_id", F.lit("lbl_")).alias("l"),
                     (-F.col("busy")).alias("b"), "debater_id")
    placed = components.withColumnRenamed("node", "debater_id").join(known, "debater_id")
    chosen = placed.groupBy("component").agg(F.min_by("debater_id", order).alias("canonical_id"))
    return (placed.join(chosen, "component").where("debater_id <> canonical_id")
            .select("debater_id", "canonical_id"))


def resolve_identities(people: DataFrame, entry_debaters: DataFrame, entry_tournaments: DataFrame,
                       members: DataFrame) -> DataFrame:
    """debater -> canonical for every record that another record stands for."""
    seen = cut_lineage(appearances(entry_debaters, entry_tournaments, people))
    components = connected_components(same_person_links(people, seen))
    return elect_canonical(components, people, seen, members)


def canonical_map(people: DataFrame, merged: DataFrame) -> DataFrame:
    return (people.select("debater_id").join(merged, "debater_id", "left")
            .select("debater_id", F.coalesce("canonical_id", "debater_id").alias("person_id")))


def pairs_by_entry(entry_debaters: DataFrame, canon: DataFrame) -> DataFrame:
    """Canonical people of an entry, sorted; ``pair`` only where there are exactly two."""
    who = (entry_debaters.join(canon, "debater_id", "left").groupBy("entry_id")
           .agg(F.array_sort(F.collect_set(F.coalesce("person_id", "debater_id"))).alias("people")))
    return who.withColumn("pair", F.when(F.size("people") == 2, F.array_join("people", "|")))


def dominant_school(rows: DataFrame, keys: list[str], members: DataFrame, order: str) -> DataFrame:
    """The school of most rows, membership breaking a tie, then whichever came first."""
    counts = (rows.where(F.col("school_id").isNotNull()).groupBy(*keys, "school_id")
              .agg(F.count("*").alias("n"), F.min(order).alias("first_seen")))
    return school_of_most(counts, keys, members)


def school_of_most(counts: DataFrame, keys: list[str], members: DataFrame) -> DataFrame:
    """As ``dominant_school``, from rows counted by school. counts: keys school_id n first_seen"""
    counts = counts.join(members.select("school_id", F.lit(1).alias("member")), "school_id", "left")
    score = F.col("n") * 2 + F.coalesce("member", F.lit(0))
    return counts.groupBy(*keys).agg(
        F.min_by("school_id", F.struct((-score).alias("s"), "first_seen")).alias("school_id"))


def collapse_partnerships(pairs: DataFrame, people: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(pair, key, representative): pairs of one school and surnames are one partnership
    unless both name different first names.

    Taken in pair order. The first pair founds its group. If it names nobody,
    the first fully named pair takes the group over, and until then everything
    joins it. Otherwise a pair joins when it names nobody or the same people,
    and founds or joins a group of its own first names when not. Stated on the
    first pairs alone, so no group is gathered anywhere.
    """
    scope = scope or []
    name = people.select("debater_id", letters("first").alias("f"), letters("last").alias("l"),
                         (F.coalesce("first", F.lit("")) != "").alias("has"))
    each = (pairs.select(*scope, "pair", F.coalesce("school_id", F.lit("")).alias("school_id"),
                         F.explode(F.split("pair", r"\|")).alias("debater_id"))
            .join(name, "debater_id", "left")
            .withColumn("f", F.coalesce("f", F.lit(""))).withColumn("l", F.coalesce("l", F.lit("")))
            .withColumn("has", F.coalesce("has", F.lit(False))))
    described = each.groupBy(*scope, "pair", "school_id").agg(
        F.array_join(F.array_sort(F.collect_list("f")), "|").alias("firsts"),
        F.array_join(F.array_sort(F.collect_list("l")), "|").alias("surnames"),
        F.bool_and("has").alias("all_named"))
    described = described.withColumn("anon", F.regexp_replace("firsts", r"\|", "") == "")
    base = [*scope, "school_id", "surnames"]
    lead = described.groupBy(*base).agg(
        F.min("pair").alias("founder"), F.min_by("anon", "pair").alias("founder_anon"),
        F.min_by("firsts", "pair").alias("founder_firsts"),
        F.min(F.when(F.col("all_named"), F.col("pair"))).alias("named_pair"),
        F.min_by("firsts", F.when(F.col("all_named"), F.col("pair"))).alias("named_firsts"))
    taken = F.col("founder_anon") & F.col("named_pair").isNotNull()
    lead = lead.withColumn("rep", F.when(taken, F.col("named_pair")).otherwise(F.col("founder")))
    base_firsts = (F.when(F.col("founder_anon"), F.col("named_firsts")).otherwise(F.col("founder_firsts")))
    joined = described.join(lead, base)
    before = F.col("founder_anon") & (F.col("named_pair").isNull() | (F.col("pair") <= F.col("named_pair")))
    in_base = before | F.col("anon") | (F.col("firsts") == base_firsts)
    base_key = F.concat_ws("::", "school_id", "surnames")
    placed = joined.withColumn("key", F.when(in_base, base_key).otherwise(
        F.concat_ws("::", base_key, "firsts"))).withColumn("in_base", in_base)
    own = placed.where(~F.col("in_base")).groupBy(*scope, "key").agg(F.min("pair").alias("own_rep"))
    return (placed.join(own, [*scope, "key"], "left")
            .select(*scope, "pair", "key",
                    F.when(F.col("in_base"), F.col("rep")).otherwise(F.col("own_rep")).alias("representative")))


def partnership_index(collapsed: DataFrame, preferred: DataFrame | None = None,
                      scope: list[str] | None = None) -> DataFrame:
    """pair -> subject: a pair the standings already use, else the representative."""
    scope = scope or []
    if preferred is None:
        return collapsed.select(*scope, "pair", F.col("representative").alias("subject"))
    used = (collapsed.join(preferred.select(*scope, "pair").distinct(), [*scope, "pair"], "left_semi")
            .groupBy(*scope, "key").agg(F.min("pair").alias("used")))
    return (collapsed.join(used, [*scope, "key"], "left")
            .select(*scope, "pair", F.coalesce("used", "representative").alias("subject")))


def partnership_names(subjects: DataFrame, people: DataFrame, schools: DataFrame) -> DataFrame:
    """Display names and school of each partnership, in member order."""
    titled = (people.join(schools.select("school_id", F.coalesce("short_name", "name").alias("school")),
                          "school_id", "left")
              .select("debater_id", F.coalesce(F.nullif(F.concat_ws(" ", F.nullif("first", F.lit("")),
                                                                    F.nullif("last", F.lit(""))), F.lit("")),
                                               "debater_id").alias("name"), "school"))
    each = subjects.select("subject", F.posexplode(F.split("subject", r"\|")).alias("i", "debater_id"))
    named = each.join(titled, "debater_id", "left").withColumn("name", F.coalesce("name", "debater_id"))
    return named.groupBy("subject").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"),
        F.min_by("school", F.when(F.col("school").isNotNull(), F.col("i"))).alias("school"))


def stale_identity_check(totals: DataFrame, merged: DataFrame) -> DataFrame:
    """Standings naming a debater that another record now stands for."""
    each = totals.select("season_id", "pair", F.explode(F.split("pair", r"\|")).alias("debater_id"))
    return each.join(merged, "debater_id")
