"""Secret scans with an incremental ledger of blobs.

Every version of every text is a blob, addressed by the digest of its content. The ledger
holds, per blob and version of the rules, what was found. A scan looks at those pairs of
blob and rule version that the ledger lacks, once each however many paths hold the blob,
and joins the findings back to all paths and versions. DataFrame functions only.

A scan of a text cuts it at the matches of a rule, so that a match's place is the total
length of what comes before it, in code points.

A null text is the empty blob. A null path is kept. Repeated rows get the same findings.
Spans of one start are listed by kind. A very long text is scanned whole, in the task that
reads it; patterns give back nothing they need not. An empty table gives an empty ledger
and no findings. Other columns are not read, but by `redact_rows`, which carries them
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.operators.prefilter import prefiltered
from corpusloom.session import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    # Least length of the group that counts; shorter matches are dropped.
    group: int = 0
    least: int = 1
    # A text without this literal has no match.
    literal: str | None = None


# The kinds of secret, in the order in which equal starts are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
        r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
        group=1, least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]++", least=16, literal="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}+", least=32),
)
MORE_RULES = (
    # To the next END line, or, where there is none, over the headers and lines of base64 that
    # follow. Line ends may be written out, as in JSON.
    Rule(
        "private_key",
        r"""-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"""
        r"""(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"""
        r"""|(?:(?:[\x20\t\r"',]*+(?:\\r)?+(?:\n|\\n)[\x20\t"',#>*]*+)++"""
        r"""(?:(?:Proc-Type|DEK-Info):[^\r\n\\]++|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:["',\\\r\n]|$)))"""
        r"""|[\x20\t]*+[A-Za-z0-9+/=]{16,}+)*+)""",
        literal="PRIVATE KEY-----",
    ),
    Rule("hub_token", {name: p for name, p, _ in fv.SECRET_RULES}["github-token"], literal="gh"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+[.]eyJ[A-Za-z0-9_-]{8,}+[.][A-Za-z0-9_-]{8,}+", literal="eyJ"),
)
# Each version of the rules is scanned for by itself, so that a new one costs its own rules only.
VERSIONS: dict[str, tuple[Rule, ...]] = {"base-1": BASE_RULES, "more-3": MORE_RULES}
KINDS = [r.kind for rules in VERSIONS.values() for r in rules]
LEDGER = "blob string, version string, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, kind, end) of the rule's matches; leftmost, not overlapping."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    sizes = F.transform(whole, lambda m: F.length(m))
    kept = F.transform(counted, lambda m: F.length(m) >= rule.least)
    gaps = F.transform(between, lambda p: F.length(p))
    # The place of match k: the gaps up to it and the matches before it.
    start = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("g"), s.alias("s"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda done, x: F.struct(
            (done["at"] + x["g"] + x["s"]).cast("bigint").alias("at"),
            F.concat(done["starts"], F.array((done["at"] + x["g"]).cast("bigint"))).alias("starts"),
        ),
        lambda done: done["starts"],
    )
    rank = KINDS.index(rule.kind)
    found = F.filter(
        F.zip_with(start, F.arrays_zip(sizes.alias("size"), kept.alias("kept")), lambda a, z: F.struct(
            a.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            (a + z["size"]).cast("bigint").alias("end"), z["kept"].alias("kept"))),
        lambda x: x["kept"],
    )
    plain = F.transform(found, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]))
    has = text.contains(rule.literal) & text.rlike(rule.pattern) if rule.literal else text.rlike(rule.pattern)
    return F.when(has, plain).otherwise(F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))


def versions_of(docs: DataFrame, path_cols: list[str], text_col: str = "text") -> DataFrame:
    """The history: path columns and `blob`, one row per path and version of its text."""
    return docs.select(*path_cols, blob_of(F.col(text_col)).alias("blob"))


def scan_new(
    docs: DataFrame, ledger: DataFrame | None, row_col: str = "doc_id", text_col: str = "text",
    versions: dict[str, tuple[Rule, ...]] = VERSIONS,
) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version not in `ledger`.

    `row_col` tells rows with different texts apart as a rule; it picks, per unseen
    blob, one row whose text is scanned. Blobs are compared by digest before any text
    moves: copies collapse in the narrow table, however many there are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(row_col, text_col).alias("_row"), blob_of(F.col(text_col)).alias("blob"))
    firsts = rows.groupBy("blob").agg(F.min("_row").alias("_row"))
    names = F.array(*[F.lit(v) for v in versions])
    if ledger is None:
        due = firsts.withColumn("_versions", names)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("version").alias("_seen"))
        left = F.array_except(names, F.coalesce(F.col("_seen"), F.array().cast("array<string>")))
        due = firsts.join(seen, "blob", "left").select("blob", "_row", left.alias("_versions"))
        due = due.where(F.size("_versions") > 0)
    texts = docs.select(F.xxhash64(row_col, text_col).alias("_row"), text.alias("_text"))
    # Equal rows have one number, and any of them will do; the digest is what decides.
    chosen = due.join(texts, "_row").where(blob_of(F.col("_text")) == F.col("blob")).select(
        "blob", "_versions", "_text")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    found = F.array(*[
        F.struct(F.lit(v).alias("version"), F.when(
            F.array_contains("_versions", v), F.concat(*[spans_of(F.col("_text"), r) for r in rules])
        ).otherwise(none).alias("spans"))
        for v, rules in versions.items()
    ])
    scanned = chosen.select("blob", "_versions", F.explode(found).alias("f")).where(
        F.array_contains("_versions", F.col("f.version")))
    return scanned.select("blob", "f.version", "f.spans").dropDuplicates(["blob", "version"])


def findings_of(history: DataFrame, ledger: DataFrame, keep: list[str], versions=VERSIONS) -> DataFrame:
    """`keep` columns of every path and version, and `spans`: all that its blob holds, by
    start and then kind as listed."""
    joined = history.join(spans_by_blob(ledger, versions), "blob", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return joined.select(*keep, F.coalesce("spans", none).alias("spans"))


def spans_by_blob(ledger: DataFrame, versions=VERSIONS) -> DataFrame:
    """(blob, spans) of the blobs that hold something, in the order of listing."""
    known = ledger.where(F.col("version").isin(*versions)).where(F.size("spans") > 0)
    return known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by [kind]."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_rows(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", row_col: str = "doc_id") -> DataFrame:
    """The rows with every secret of their text replaced by its kind, and, where there is
    such a column, its length. All other columns are carried as they are, whatever their
    names: a row travels as one struct. A null text stays null."""
    ledger = cut(scan_new(docs, None, row_col, text_col))
    found = cut(spans_by_blob(ledger))
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    text = F.col(f"r.`{text_col}`")
    history = docs.select(row.alias("r"), blob_of(docs[f"`{text_col}`"]).alias("blob"))
    # Texts without a secret are not shuffled.
    hit = prefiltered(history, found, "blob").join(found, "blob", "left")
    clean = hit.withColumn("clean", F.when(F.col("spans").isNotNull(), redacted(text, F.col("spans"))).otherwise(text))
    changed = ~text.eqNullSafe(F.col("clean"))
    columns = []
    for name in docs.columns:
        own = F.col(f"r.`{name}`")
        if name == text_col:
            own = F.col("clean")
        elif name == length_col:
            own = F.when(changed, F.length("clean")).otherwise(own).cast(docs.schema[name].dataType)
        columns.append(own.alias(name))
    return prefiltered(history, found, "blob", others=True).select("r.*").unionByName(clean.select(*columns))
