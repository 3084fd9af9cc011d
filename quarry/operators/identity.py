"""Who wrote what: joins between papers, authors and members of staff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.normal import norm_key


def email_prefix(c: str = "email") -> Column:
    return norm_key(F.split(c, "@")[0])


def display_name() -> Column:
    """Title, first and last name, blank parts skipped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", "title", "firstname", "lastname"), r"\s+", " "))


def faculty_ids(faculty: DataFrame) -> DataFrame:
    """``expert_id, id_kind, id``: every scopus id and the kerberos (email prefix) of a profile."""
    pairs = F.concat(
        F.transform(F.coalesce("scopus_id", F.array().cast("array<string>")), lambda s: F.struct(F.lit("scopus").alias("kind"), norm_key(s).alias("id"))),
        F.array(F.struct(F.lit("kerberos").alias("kind"), email_prefix().alias("id"))),
    )
    return faculty.select(norm_key("expert_id").alias("expert_id"), F.explode(F.array_distinct(pairs)).alias("p")).select("expert_id", F.col("p.kind").alias("id_kind"), F.col("p.id").alias("id")).where("id IS NOT NULL AND expert_id IS NOT NULL")


def paper_ids(papers: DataFrame) -> DataFrame:
    """``paper_key, id_kind, id``: author ids and the owner's kerberos of a paper, once each."""
    pairs = F.concat(
        F.transform(F.coalesce("authors", F.array().cast(papers.schema["authors"].dataType)), lambda a: F.struct(F.lit("scopus").alias("kind"), norm_key(a["author_id"]).alias("id"))),
        F.array(F.struct(F.lit("kerberos").alias("kind"), norm_key("kerberos").alias("id"))),
    )
    return papers.select("paper_key", F.explode(F.array_distinct(pairs)).alias("p")).select("paper_key", F.col("p.kind").alias("id_kind"), F.col("p.id").alias("id")).where("id IS NOT NULL")


def authorship(papers: DataFrame, faculty: DataFrame) -> DataFrame:
    """``paper_key, expert_id, matched_via`` (``kerberos``, ``scopus_id`` or ``both``), one row per paper and profile."""
    m = paper_ids(papers).join(faculty_ids(faculty), ["id_kind", "id"])
    g = m.groupBy("paper_key", "expert_id").agg(F.max((F.col("id_kind") == "kerberos").cast("int")).alias("k"), F.max((F.col("id_kind") == "scopus").cast("int")).alias("s"))
    via = F.when((F.col("k") == 1) & (F.col("s") == 1), "both").when(F.col("k") == 1, "kerberos").otherwise("scopus_id")
    return g.select("paper_key", "expert_id", via.alias("matched_via"))


def resolved_authorship(papers: DataFrame, faculty: DataFrame) -> DataFrame:
    """:func:`authorship` plus owners nobody matches, kept without a profile (``csv_fallback``)."""
    a = authorship(papers, faculty).withColumn("kerberos", F.lit(None).cast("string")).withColumn("source", F.lit("faculty"))
    known = faculty.select(email_prefix().alias("kerberos")).where("kerberos IS NOT NULL").distinct()
    owner = papers.select("paper_key", norm_key("kerberos").alias("kerberos")).where("kerberos IS NOT NULL")
    rest = owner.join(known, "kerberos", "left_anti").select("paper_key", F.lit(None).cast("string").alias("expert_id"), F.lit("kerberos").alias("matched_via"), "kerberos", F.lit("csv_fallback").alias("source"))
    return a.unionByName(rest)


def hydrate(hits: DataFrame, docs: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """Hits with their documents' columns, in hit order by ``rank``; hits without a document drop out."""
    return hits.join(docs.select(F.col(doc_id).alias("doc_id"), *columns), "doc_id").select("rank", "doc_id", *columns)


def resolve_profile(faculty: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, expert_id`` for ids that are a scopus id (first choice) or an expert id; smallest profile wins a tie."""
    by_scopus = faculty_ids(faculty).where("id_kind = 'scopus'").select("id", F.lit(0).alias("o"), "expert_id")
    by_expert = faculty.select(norm_key("expert_id").alias("id"), F.lit(1).alias("o"), norm_key("expert_id").alias("expert_id"))
    return ids.join(by_scopus.unionByName(by_expert), "id").groupBy("id").agg(F.min(F.struct("o", "expert_id")).alias("b")).select("id", "b.expert_id")


def coauthors(papers: DataFrame, author_ids: list[str], size: int = 50) -> DataFrame:
    """``rank, author_id, n``: author entries on the papers of ``author_ids``, these excluded; entries count, repeated ones too."""
    mine = papers.where(F.exists("authors", lambda a: norm_key(a["author_id"]).isin(author_ids)))
    x = mine.select(F.explode("authors").alias("a")).select(norm_key("a.author_id").alias("author_id")).where(F.col("author_id").isNotNull() & ~F.col("author_id").isin(author_ids))
    top = x.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author_id").limit(size)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "author_id"))).select("rank", "author_id", "n")


def lead_author() -> Column:
    """Id of the author at position 1, else at the least numeric position, else the first listed."""
    order = F.transform("authors", lambda a, i: F.struct(F.coalesce(F.try_to_number(F.trim(a["author_position"]), F.lit("999999")).cast("int"), F.lit(1 << 30)).alias("p"), i.alias("i"), norm_key(a["author_id"]).alias("id")))
    return F.array_min(order)["id"]


def name_variants() -> Column:
    """Ordered distinct spellings of a profile's name: plain, titled, last first, with comma, and three with initials."""
    f, l, t = F.trim("firstname"), F.trim("lastname"), F.trim("title")
    words = F.filter(F.split(f, r"\s+"), lambda w: w != "")
    initials = F.transform(words, lambda w: F.substring(w, 1, 1))
    dotted = F.array_join(F.transform(initials, lambda i: F.concat(i, F.lit("."))), " ")
    forms = [
        F.concat_ws(" ", f, l), F.concat_ws(" ", t, f, l), F.concat_ws(" ", l, f), F.concat_ws(", ", l, f),
        F.concat_ws(" ", dotted, l), F.concat_ws(" ", l, dotted), F.concat_ws(" ", F.array_join(initials, ""), l),
    ]
    return F.array_distinct(F.filter(F.transform(F.array(*forms), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def by_department(experts: DataFrame, departments: DataFrame) -> DataFrame:
    """People grouped by department: ``rank, department_name, people, papers, citations, score``.

    ``experts``: ``expert_id, department, papers, citations, score``. The score is
    the mean of the best three times (1 + 0.1 log2 n). Most cited first, people
    without a known department together as "Other", last.
    """
    d = departments.select(norm_key("department_id").alias("department"), "department_name")
    x = experts.join(d, "department", "left").withColumn("department_name", F.coalesce("department_name", F.lit("Other")))
    r = F.row_number().over(W.partitionBy("department_name").orderBy(F.desc("score"), "expert_id"))
    g = x.withColumn("r", r).groupBy("department_name").agg(
        F.count(F.lit(1)).alias("people"), F.sum("papers").alias("papers"), F.sum("citations").alias("citations"), F.avg(F.when(F.col("r") <= 3, F.col("score"))).alias("top")
    )
    g = g.withColumn("score", F.round(F.col("top") * (1 + 0.1 * F.log2(F.col("people"))), 4)).drop("top")
    other = (F.col("department_name") == "Other").cast("int")
    return g.withColumn("rank", F.row_number().over(W.orderBy(other, F.desc("citations"), F.desc("score"), "department_name")))


def author_query(faculty: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """``expert_id`` of the profiles a name as typed may mean: the first step of the cascade that finds any.

    First and last word as first and last name; the last word as last name; one
    word as either; the whole text as the full name. Compared trimmed and in
    lower case; ties by id.
    """
    words = query.lower().split()
    first, last = norm_key("firstname"), norm_key("lastname")
    full = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", "firstname", "lastname"), r"\s+", " ")))
    found = faculty.limit(0).select("expert_id")
    steps = [(first == words[0]) & (last == words[-1]), last == words[-1]] if len(words) > 1 else [(first == words[0]) | (last == words[0])] if words else []
    for step in [*steps, full == " ".join(words)] if words else []:
        found = faculty.where(step).select("expert_id")
        if not found.isEmpty():
            break
    return found.orderBy("expert_id").limit(limit)
