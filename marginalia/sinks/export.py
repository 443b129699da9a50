"""Notebook export: Markdown, BibTeX and RIS, one text per notebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.citations import LOW_COVERAGE
from ..schema import REPORT

# fixed values: how characters are escaped in TeX
TEX = {
    "\\": "\\\\", "%": "\\%", "&": "\\&", "$": "\\$", "#": "\\#", "_": "\\_", "^": "\\^{}", "~": "\\~{}", "{": "{\\{}", "}": "{\\}}",
}
# fixed values: labels
LABELS = {
    "en": {
        "sources": "Sources", "notes": "Notes", "studio": "Studio Output", "chat": "Chat History", "legend": "sources", "degraded": "search only",
        "invalid": "⚠ invalid citations", "misattributed": "⚠ possible wrong source", "confirmed": "✓ grounding confirmed",
        "uncited": "⚠ uncited assertions", "coverage": "⚠ low citation coverage",
    },
    "ja": {
        "sources": "ソース", "notes": "ノート", "studio": "Studio出力", "chat": "チャット履歴", "legend": "引用元", "degraded": "検索のみ",
        "invalid": "⚠検証失敗", "misattributed": "⚠番号取り違えの可能性", "confirmed": "✓根拠確認済み", "uncited": "⚠無出典の断定文",
        "coverage": "⚠引用被覆 低",
    },
}
WEB_KINDS = ("url", "html")


def labels(lang: str) -> dict[str, str]:
    return LABELS.get(lang, LABELS["en"])


def parsed_report(raw: Column) -> Column:
    """A stored report; null fields where the JSON is broken or something else."""
    return F.from_json(F.coalesce(raw, F.lit("{}")), REPORT, {"mode": "PERMISSIVE"})


def status_line(report: Column, lang: str = "en") -> Column:
    """What the checks found, joined by " / "; empty if nothing."""
    say = labels(lang)
    some = lambda c: F.coalesce(F.size(report[c]), F.lit(0)) > 0

    def numbers(field: str) -> Column:
        named = F.array_join(F.transform(report[field], lambda i: F.concat(F.lit("S"), i.cast("string"))), ", ")
        return F.when(some(field), F.concat(F.lit(f"{say[field]}: "), named))

    low = some("cited") & (report["n_sources"] > 0) & (report["coverage"] < LOW_COVERAGE)
    share = F.concat(F.lit(f"{say['coverage']} ("), F.size(F.array_distinct(report["cited"])), F.lit("/"), report["n_sources"], F.lit(")"))
    count = F.concat(F.lit(f"{say['uncited']} ("), F.size(report["uncited"]), F.lit(")"))
    return F.concat_ws(
        " / ", F.when(report["degraded"], F.lit(say["degraded"])), numbers("invalid"), numbers("misattributed"), numbers("confirmed"),
        F.when(some("uncited"), count), F.when(low, share),
    )


def tex_escaped(c: Column) -> Column:
    """One line, each special character replaced once."""
    table = F.create_map(*(F.lit(x) for pair in TEX.items() for x in pair))
    return F.array_join(F.transform(F.split(X.one_line(c), ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def _day(added: Column) -> Column:
    return F.substring(F.coalesce(added, F.lit("")), 1, 10)


def _year(added: Column) -> Column:
    year = F.substring(F.coalesce(added, F.lit("")), 1, 4)
    return F.when(year.rlike("^[0-9]{4}$"), year)


def _joined(entries: DataFrame, group: str, order: str) -> DataFrame:
    sorted_ = F.sort_array(F.collect_list(F.struct(order, "entry")))
    return entries.groupBy(group).agg(sorted_.alias("r")).select(group, F.concat(F.array_join("r.entry", "\n\n"), F.lit("\n")).alias("body"))


def bibtex(sources: DataFrame, key_prefix: str = "source", label: str = "Source") -> DataFrame:
    """(notebook_id, body) from sources (id, notebook_id, title, origin, added_at as ISO text)."""
    added = F.col("added_at")
    day = F.when(_day(added) == "", "unknown").otherwise(_day(added))
    rows = F.concat_ws(
        "\n", F.concat(F.lit(f"@misc{{{key_prefix}"), F.col("id"), F.lit(",")), F.concat(F.lit("  title = {"), tex_escaped(F.col("title")), F.lit("},")),
        F.concat(F.lit("  howpublished = {"), tex_escaped(F.col("origin")), F.lit("},")), F.concat(F.lit("  year = {"), _year(added), F.lit("},")),
        F.concat(F.lit(f"  note = {{{label}, added "), day, F.lit("}")), F.lit("}"),
    )
    return _joined(sources.select("notebook_id", "id", rows.alias("entry")), "notebook_id", "id")


def ris(sources: DataFrame) -> DataFrame:
    """(notebook_id, body) in RIS."""
    added = F.col("added_at")
    day = F.when(_day(added) == "", "unknown").otherwise(F.replace(_day(added), F.lit("-"), F.lit("/")))
    kind = F.when(F.col("kind").isin(*WEB_KINDS), "ELEC").otherwise("GEN")
    rows = F.concat_ws(
        "\n", F.concat(F.lit("TY  - "), kind), F.concat(F.lit("TI  - "), X.one_line(F.col("title"))), F.concat(F.lit("UR  - "), X.one_line(F.col("origin"))),
        F.concat(F.lit("PY  - "), _year(added)), F.concat(F.lit("DA  - "), day), F.lit("ER  -"),
    )
    return _joined(sources.select("notebook_id", "id", rows.alias("entry")), "notebook_id", "id")


def legend(report: Column) -> Column:
    """The sources that an answer's numbers stand for, by number."""
    entries = F.array_sort(F.transform(F.map_entries(report["source_map"]), lambda e: F.struct(F.substring(e["key"], 2, 9).try_cast("int").alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    part = lambda k: F.try_element_at(report["source_contexts"], k)
    text = lambda e: F.concat(e["k"], F.lit("="), e["v"], F.when(F.coalesce(part(e["k"]), F.lit("")) != "", F.concat(F.lit(" (§ "), part(e["k"]), F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(entries, text), ", ")


def markdown(notebooks: DataFrame, sources: DataFrame, notes: DataFrame, outputs: DataFrame, messages: DataFrame, lang: str = "en") -> DataFrame:
    """(notebook_id, body): sources, notes, latest outputs by kind and the conversation of each notebook."""
    say = labels(lang)

    def part(rows: DataFrame, section: int, order: str, text: Column) -> DataFrame:
        return rows.select("notebook_id", F.lit(section).alias("section"), F.row_number().over(_by(order)).alias("at"), text.alias("entry"))

    def _by(order: str):
        return Window.partitionBy("notebook_id").orderBy(order)

    def starred(report: Column) -> Column:
        line = status_line(report, lang)
        return F.when(line != "", F.concat(F.lit("\n*"), line, F.lit("*"))).otherwise("")

    body = F.coalesce("body", F.lit(""))
    listed = F.concat(F.lit("- [S"), F.row_number().over(_by("id")), F.lit("] "), X.one_line(F.col("title")), F.lit(" ("), F.col("kind"), F.lit(") — "), X.one_line(F.col("origin")))
    note = F.concat(F.lit("### "), X.one_line(F.col("title")), F.lit("\n"), body, F.lit("\n"))
    report = parsed_report(F.col("citation_report"))
    output = F.concat(F.lit("### "), F.col("kind"), F.lit("\n"), body, starred(report), F.lit("\n"))
    named = F.when(F.coalesce(F.size(report["source_map"]), F.lit(0)) > 0, F.concat(F.lit(f"**Assistant** ({say['legend']}: "), legend(report), F.lit("):"))).otherwise("**Assistant**:")
    said = F.when(F.col("role") == "user", F.concat(F.lit("**User**: "), X.one_line(F.col("body")), F.lit("\n"))).otherwise(F.concat(named, F.lit("\n"), body, starred(report), F.lit("\n")))
    every = part(sources, 1, "id", listed).unionByName(part(notes, 2, "id", note)).unionByName(part(outputs, 3, "kind", output)).unionByName(part(messages, 4, "id", said))
    sections = every.groupBy("notebook_id", "section").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "entry")))["entry"], "\n").alias("rows"))
    head = F.element_at(F.array(*(F.lit(f"## {say[k]}\n") for k in ("sources", "notes", "studio", "chat"))), F.col("section"))
    sections = sections.select("notebook_id", "section", F.concat(head, "rows", F.when(F.col("section") == 1, "\n").otherwise("")).alias("part"))
    parts = sections.groupBy("notebook_id").agg(F.sort_array(F.collect_list(F.struct("section", "part"))).alias("p"))
    named_parts = notebooks.select(F.col("id").alias("notebook_id"), "name").join(parts, "notebook_id", "left")
    none = F.lit(f"## {say['sources']}\n\n")
    has_sources = F.exists(F.coalesce(F.col("p.section"), F.array().cast("array<int>")), lambda s: s == 1)
    text = F.concat(F.lit("# "), X.one_line(F.col("name")), F.lit("\n\n"), F.when(has_sources, F.lit("")).otherwise(none), F.coalesce(F.array_join("p.part", "\n"), F.lit("")))
    return named_parts.select("notebook_id", F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n")).alias("body"))


def export(fmt: str, **tables: DataFrame) -> DataFrame:
    """Dispatch by format: md, bibtex or ris."""
    if fmt == "md":
        return markdown(tables["notebooks"], tables["sources"], tables["notes"], tables["outputs"], tables["messages"])
    if fmt == "bibtex":
        return bibtex(tables["sources"])
    if fmt == "ris":
        return ris(tables["sources"])
    raise ValueError(f"no such export format: {fmt}")


def write_exports(exported: DataFrame, path: str) -> None:
    """One text file set per notebook, partitioned by its id."""
    exported.select("notebook_id", "body").write.partitionBy("notebook_id").option("lineSep", "\n").text(path)
