"""Queries over the test tables, one or more for each family of operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..codes import DISK_CODES, TO_DISK, CheckMode, Compression, DeltaType, MakeOptions, strerror
from ..functions import binary, codecs
from ..operators import archive, check, copies, diff, make, sequence
from ..sources import deltas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(c: Column | str) -> Column:
    return F.lower(F.hex(c))


# -- pairs ------------------------------------------------------------------------------------------------


def prefix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first one (by doc_id) of the same 32 characters: likely copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"), F.substring("text", 1, 32).alias("start"))
    first = docs.groupBy("start").agg(F.min("doc_id").alias("first"))
    old = docs.select(F.col("doc_id").alias("first"), F.col("data").alias("old"))
    return docs.join(first, "start").where("doc_id <> first").join(old, "first").select(F.col("doc_id").alias("pair_id"), "old", F.col("data").alias("new"))


PREFIX = """
WITH pairs AS (SELECT n.doc_id AS pair_id, o.text AS old, n.text AS new
  FROM documents n JOIN (SELECT substr(text, 1, 32) AS start, min(doc_id) AS first FROM documents GROUP BY 1) f ON substr(n.text, 1, 32) = f.start AND n.doc_id <> f.first
  JOIN documents o ON o.doc_id = f.first)
"""


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the one of the next smaller page_id, which shares its frame."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("html"))
    # ids are dense: the page before is a join, not a window over all rows
    return pages.join(pages.select((F.col("page_id") + 1).alias("page_id"), F.col("html").alias("old")), "page_id").select(F.col("page_id").alias("pair_id"), "old", F.col("html").alias("new"))


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one before it of its source: unrelated texts."""
    docs = table(spark, sf_dir, "documents")
    near = Window.partitionBy("source").orderBy("doc_id")
    found = docs.select("doc_id", "source", F.lag("doc_id").over(near).alias("before")).where("before is not null")
    old = docs.select(F.col("doc_id").alias("before"), F.col("text").cast("binary").alias("old"))
    new = docs.select("doc_id", F.col("text").cast("binary").alias("new"))
    return found.join(old, "before").join(new, "doc_id").select(F.col("doc_id").alias("pair_id"), "old", "new")


def _round_trip(pairs: DataFrame, addblk: bool = False, relational: bool = False) -> DataFrame:
    made = copies.delta_rows(diff.diff_pairs(pairs, addblk))
    replay = copies.replay_relational if relational else copies.replay
    return replay(pairs.select("pair_id", "old"), made).select("pair_id", F.decode("new", "utf-8").alias("text"))


# -- making and replaying -----------------------------------------------------------------------------------


@query(PREFIX + "SELECT pair_id, new AS text FROM pairs")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(prefix_pairs(spark, sf_dir))


@query("SELECT n.page_id AS pair_id, n.html AS text FROM pages n JOIN pages o ON n.page_id = o.page_id + 1")
def delta_roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(page_pairs(spark, sf_dir))


@query("SELECT doc_id AS pair_id, text FROM (SELECT doc_id, text, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b IS NOT NULL")
def delta_roundtrip_dissimilar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(source_pairs(spark, sf_dir))


@query(PREFIX + "SELECT pair_id, new AS text FROM pairs")
def delta_roundtrip_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(prefix_pairs(spark, sf_dir), relational=True)


@query(PREFIX + "SELECT pair_id, new AS text FROM pairs")
def delta_roundtrip_addblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(prefix_pairs(spark, sf_dir), addblk=True)


@query("SELECT doc_id AS pair_id, text FROM documents")
def delta_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").cast("binary").alias("old"))
    return _round_trip(docs.withColumn("new", F.col("old")))


@query(PREFIX + "SELECT count(*) AS pairs, CAST(sum(strlen(new)) AS BIGINT) AS bytes, TRUE AS whole, TRUE AS equal_pairs_copied FROM pairs")
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = prefix_pairs(spark, sf_dir)
    rows = diff.diff_pairs(pairs).select("pair_id", "literals", F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["old_len"]).alias("copied"))
    both = rows.join(pairs.select("pair_id", F.octet_length("new").alias("size"), ((F.col("old") == F.col("new")) & (F.octet_length("new") >= 32)).alias("equal")), "pair_id")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("size").cast("long").alias("bytes"), F.bool_and(F.col("copied") + F.octet_length("literals") == F.col("size")).alias("whole"),
        F.bool_and(~F.col("equal") | (F.octet_length("literals") == 0)).alias("equal_pairs_copied"),
    )


def _alone(spark: SparkSession, sf_dir: str, options: MakeOptions) -> DataFrame:
    """The delta of each document's package to itself, applied, with what the delta says."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = make.wrap_archives(docs, "pair_id", "text").select("pair_id", F.lit(None).cast("binary").alias("old"), F.col("package").alias("new"))
    made = make.make_table(packed, options, keep=("new",)).select("pair_id", F.col("new").alias("old"), F.col("result").alias("delta"), F.col("status").alias("made"))
    done = make.apply_table(made, keep=("old", "delta", "made"))
    done = done.select("pair_id", "status", "made", "old", (F.col("result") == F.col("old")).alias("same"), F.struct("pair_id", "status", "made", "old", (F.col("result") == F.col("old")).alias("same")).alias("all"), "delta")
    view = deltas.info(deltas.parse_files(done, "pair_id", "delta", keep=("all",)), keep=("all",))
    body = F.substring("all.old", (F.length("tgt_leadsig") / 2).cast("int") + 1, F.octet_length("all.old"))
    return view.select(
        "all.pair_id", "all.status", "all.made", "all.same", "type", "src_nevr", F.coalesce(F.size("ext_copies"), F.lit(0)).alias("n_copies"), (F.col("tgt_md5") == F.md5("all.old")).alias("digest"),
        (F.col("tgt_size") == F.octet_length("all.old")).alias("sized"), (F.substring("sequence", 1, 32) == F.md5(body)).alias("signed"),
    )


@query("SELECT doc_id AS pair_id, 0 AS made, 0 AS status, TRUE AS same, 1 AS type, 'data-' || doc_id || '-1' AS src_nevr, 0 AS n_copies, TRUE AS digest, TRUE AS sized, TRUE AS signed FROM documents")
def delta_nodiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rpm-only deltas of one package: nothing is compared or copied."""
    return _alone(spark, sf_dir, MakeOptions().with_type(DeltaType.RPMONLY)).withColumn("n_copies", F.greatest("n_copies", F.lit(0)))


@query("SELECT doc_id AS pair_id, 0 AS made, 0 AS status, TRUE AS same, 0 AS type, 'data-' || doc_id || '-1' AS src_nevr, TRUE AS digest, TRUE AS sized FROM documents")
def delta_identity_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deltas of one package to itself."""
    return _alone(spark, sf_dir, MakeOptions()).drop("n_copies", "signed")


# -- copy lists, from integers of the events of each user --------------------------------------------------------


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", (F.pmod("event_id", F.lit(13)) - 4).alias("adj"), (F.pmod("event_id", F.lit(29)) + 1).alias("len"))


LIST = "WITH l AS (SELECT user_id, event_id, event_id % 13 - 4 AS adj, event_id % 29 + 1 AS len FROM events)\n"
OFF = LIST + ", o AS (SELECT *, adj + coalesce(sum(adj + len) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)\n"


@query(OFF + "SELECT user_id, event_id, CAST(off AS BIGINT) AS off FROM o")
def copylist_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.offsets(_list(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "off")


@query(OFF + "SELECT user_id, bool_and(off >= 0 AND off + len > 0 AND off + len <= 2000) AS ok FROM o GROUP BY user_id")
def copylist_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.valid(_list(spark, sf_dir), "user_id", "event_id", F.lit(2000))


@query(OFF + "SELECT user_id, event_id, adj FROM l")
def copylist_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = copies.offsets(_list(spark, sf_dir), "user_id", "event_id").drop("adj")
    return copies.adjustments(placed, "user_id", "event_id").select("user_id", "event_id", "adj")


@query("""
WITH g AS (SELECT user_id, event_id % 5 = 0 AS ins, coalesce(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM events)
SELECT user_id, CAST(grp AS BIGINT) AS "group", CAST(sum(CASE WHEN ins THEN 0 ELSE 1 END) AS BIGINT) AS n_ext FROM g GROUP BY user_id, grp
""")
def copylist_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.sessions(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", F.pmod("event_id", F.lit(5)) == 0).select("user_id", "group", "n_ext")


@query("""
WITH b AS (SELECT user_id, event_id, unnest(range(CAST(event_id % 977 // 64 AS BIGINT), CAST((event_id % 977 + event_id % 300) // 64 + 1 AS BIGINT))) AS block FROM events)
SELECT user_id, block, max(event_id) AS last FROM b GROUP BY user_id, block
""")
def block_last_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod("event_id", F.lit(977)).alias("off"), (F.pmod("event_id", F.lit(300)) + 1).alias("len"))
    return copies.last_copies(e, "user_id", "event_id", 64)


# -- matching --------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT n.page_id AS pair_id, encode(o.html) AS old, encode(n.html) AS new FROM pages n JOIN pages o ON n.page_id = o.page_id + 1),
     ob AS (SELECT pair_id, min(i) AS old_off, old[i + 1 : i + 16] AS gram FROM (SELECT pair_id, old, unnest(range(0, octet_length(old) - 15, 16)) AS i FROM p) GROUP BY pair_id, gram),
     nb AS (SELECT pair_id, i AS new_off, new[i + 1 : i + 16] AS gram FROM (SELECT pair_id, new, unnest(range(0, octet_length(new) - 15)) AS i FROM p))
SELECT nb.pair_id AS pair_id, CAST(ob.old_off AS BIGINT) AS old_off, CAST(nb.new_off AS BIGINT) AS new_off FROM ob JOIN nb ON ob.pair_id = nb.pair_id AND ob.gram = nb.gram
""")
def block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits from which copies are made: every place of the new page that holds an aligned block of the old one."""
    return diff.hit_rows(page_pairs(spark, sf_dir))


@query(PREFIX + """, b AS (SELECT pair_id, encode(old) AS a, encode(new) AS b FROM pairs),
     d AS (SELECT pair_id, min(i) AS i FROM (SELECT pair_id, a, b, unnest(range(1, least(octet_length(a), octet_length(b)) + 1)) AS i FROM b) WHERE a[i : i] <> b[i : i] GROUP BY pair_id)
SELECT b.pair_id AS pair_id, CAST(coalesce(d.i - 1, least(octet_length(b.a), octet_length(b.b))) AS BIGINT) AS length FROM b LEFT JOIN d ON b.pair_id = d.pair_id
""")
def longest_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.prefix_lengths(prefix_pairs(spark, sf_dir))


@query(PREFIX + """, b AS (SELECT hex(encode(old)) AS a, hex(encode(new)) AS b FROM pairs),
     x AS (SELECT a, b, unnest(range(0, least(length(a), length(b)) // 2)) AS i FROM b),
     v AS (SELECT (strpos('0123456789ABCDEF', substr(b, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(b, 2 * i + 2, 1)) - 1
                - (strpos('0123456789ABCDEF', substr(a, 2 * i + 1, 1)) - 1) * 16 - strpos('0123456789ABCDEF', substr(a, 2 * i + 2, 1)) + 1 AS d FROM x)
SELECT CAST((d + 256) % 256 AS INTEGER) AS difference, count(*) AS n FROM v GROUP BY 1
""")
def byte_diff_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.difference_histogram(prefix_pairs(spark, sf_dir))


# -- manifests and sequences ---------------------------------------------------------------------------------------


@query("""
SELECT d.doc_id AS doc_id, NOT (strlen(d.text) <> d.n_chars OR l.toxic = 1 OR l.quality = 0) AS eligible FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive entries, labels as their manifest: flags and verify bits from the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = docs.select("source", F.concat(F.lit("./"), F.col("doc_id")).alias("name"), F.octet_length("text").alias("entry_size"), "n_chars", "doc_id")
    rows = docs.join(labels, "doc_id").select("source", F.concat(F.lit("/"), F.col("doc_id")).alias("name"), F.col("doc_id").alias("ord"), F.col("toxic").cast("long").alias("flags"), (F.col("quality") * 3).cast("long").alias("verify"))
    joined = archive.join_manifest(found, rows, "source")
    ok = archive.eligible(F.col("path"), F.lit(0o100644), F.col("entry_size"), F.col("n_chars"), F.col("flags"), F.col("verify"), F.lit(None).cast("int"))
    return joined.select("doc_id", ok.alias("eligible"))


@query("""
SELECT d.doc_id AS doc_id, coalesce(p.quality = 1, FALSE) AND (b.item_id IS NULL OR md5(b.text) <> md5(d.text)) AS unpatched
FROM documents d LEFT JOIN labels p ON d.doc_id = p.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id
""")
def unpatched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.md5("text").alias("md5"))
    printed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("mark"))
    patched = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.md5("text").alias("md5"))
    return archive.is_unpatched(files, printed, patched).select(F.col("name").alias("doc_id"), "unpatched")


PART = "source || '/' || (doc_id // 1000)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``part``, their source and thousand: at most 1000 rows of distinct ids each."""
    return table(spark, sf_dir, "documents").withColumn("part", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 1000)))


@query(f"SELECT {PART} AS part, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parts(spark, sf_dir).select("part", "doc_id", F.md5("text").cast("binary").alias("entry"))
    return sequence.digest_by(docs, "part", "doc_id", "entry")


@query(f"""
WITH f AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 33188 WHEN 1 THEN 41471 WHEN 2 THEN 24960 ELSE 16877 END AS mode FROM documents)
SELECT {PART} AS part, md5(unhex(string_agg(hex(encode('data/' || doc_id)) || '00' || printf('%08X', mode)
  || printf('%08X', CASE doc_id % 4 WHEN 0 THEN strlen(text) WHEN 1 THEN strlen(lang) ELSE 0 END) || printf('%08X', CASE doc_id % 4 WHEN 2 THEN doc_id % 65536 ELSE 0 END)
  || CASE WHEN doc_id % 4 = 0 AND strlen(text) > 0 THEN upper(md5(text)) WHEN doc_id % 4 = 1 THEN hex(encode(lang)) || '00' ELSE '' END, '' ORDER BY doc_id))) AS digest
FROM f GROUP BY 1
""")
def sequence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, links, devices and directories, with device numbers that count for devices only."""
    docs = _parts(spark, sf_dir)
    kind = F.pmod("doc_id", F.lit(4))
    mode = F.when(kind == 0, F.lit(0o100644)).when(kind == 1, F.lit(0o120777)).when(kind == 2, F.lit(0o060600)).otherwise(F.lit(0o040755))
    entry = sequence.file_entry(F.concat(F.lit("/data/"), F.col("doc_id")), mode, F.octet_length("text").cast("long"), F.pmod("doc_id", F.lit(65536)), F.col("lang"), F.unhex(F.md5("text")))
    return sequence.digest_by(docs.select("part", "doc_id", entry.alias("entry")), "part", "doc_id", "entry")


RUNS = f"WITH g AS (SELECT part, pos, pos - row_number() OVER (PARTITION BY part ORDER BY pos) AS g FROM (SELECT DISTINCT {PART} AS part, doc_id AS pos FROM documents))\n"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a source leave gaps, as do files of a manifest that are not kept."""
    return sequence.file_runs(_parts(spark, sf_dir).select("part", F.col("doc_id").alias("pos")).distinct(), "part", "pos")


@query(RUNS + "SELECT part, min(pos) AS first, count(*) AS n FROM g GROUP BY part, g")
def sequence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(RUNS + "SELECT part, pos AS position FROM g")
def sequence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.expand_runs(_runs(spark, sf_dir), "part")


@query(RUNS + "SELECT part, CAST(count(*) AS INTEGER) AS n, TRUE AS same FROM g GROUP BY part")
def sequence_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = sequence.expand_runs(_runs(spark, sf_dir), "part").groupBy("part").agg(F.array_sort(F.collect_list(F.col("position").cast("int"))).alias("positions"))
    coded = lists.withColumn("again", sequence.order_positions(sequence.order_bytes(F.col("positions")), F.lit(2**31 - 2)))
    return coded.select("part", F.size("positions").alias("n"), (F.col("again") == F.col("positions")).alias("same"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(110 + strlen(role) + 1 + strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def cpio_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.octet_length("role") + 111).alias("header_len"), F.octet_length("text").alias("content_len"))
    return archive.entry_offsets(c, "conv_id", "turn").select("conv_id", "turn", "offset")


@query("SELECT conv_id, turn, role AS name, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM conversations")
def cpio_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn packed as an archive of one entry, made of columns, and scanned again."""
    c = table(spark, sf_dir, "conversations")
    name, data = F.encode("role", "utf-8"), F.encode("text", "utf-8")
    size, names = F.octet_length(data), F.octet_length(name) + 1
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n))
    fields = [F.lit(0), F.lit(0o100644), F.lit(0), F.lit(0), F.lit(1), F.lit(0), size, F.lit(0), F.lit(0), F.lit(0), F.lit(0), names]
    entry = F.concat(binary.cpio_header(fields).cast("binary"), name, zeros(F.lit(1)), zeros(binary.padding(names + 110, 4).cast("int")), data, zeros(binary.padding(size, 4).cast("int")))
    trailer = F.lit(archive.pack({"nlink": 1}, archive.TRAILER.encode()))
    packed = c.select(F.struct("conv_id", "turn").alias("key"), F.concat(entry, trailer).alias("data"))
    return archive.scan(packed, "key", "data").select("key.conv_id", "key.turn", "name", "size", F.md5("content").alias("md5"))


# -- checks ----------------------------------------------------------------------------------------------------------


def _installed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of all documents, and files of which some are missing, changed or longer."""
    docs = table(spark, sf_dir, "documents")
    manifest = docs.select(F.col("source").alias("delta_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.md5("text").alias("digest"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 13 == 0, F.reverse("text")).otherwise(F.col("text"))
    found = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(text).alias("size"), text.cast("binary").alias("content"))
    return manifest, found


CHECK = "CASE WHEN doc_id % 17 = 0 THEN {none} WHEN doc_id % 11 = 0 THEN {longer} WHEN doc_id % 13 = 0 AND reverse(text) <> text THEN {changed} ELSE 0 END"


@query(f"SELECT source AS delta_id, doc_id AS pos, CAST({CHECK.format(none=10, longer=9, changed=0)} AS INTEGER) AS status FROM documents")
def check_filesizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check_files(*_installed(spark, sf_dir), CheckMode.FILESIZES).select("delta_id", "pos", "status")


@query(f"SELECT source AS delta_id, doc_id AS pos, CAST({CHECK.format(none=3, longer=0, changed=9)} AS INTEGER) AS status FROM documents")
def check_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check_files(*_installed(spark, sf_dir), CheckMode.FULL).select("delta_id", "pos", "status")


@query(f"""
WITH s AS (SELECT source, doc_id, {CHECK.format(none=3, longer=0, changed=9)} AS status FROM documents)
SELECT source AS delta_id, CAST(coalesce(max(CASE WHEN doc_id = first THEN status END), 0) AS INTEGER) AS status, count(CASE WHEN status <> 0 THEN 1 END) AS failed
FROM (SELECT s.*, min(CASE WHEN status <> 0 THEN doc_id END) OVER (PARTITION BY source) AS first FROM s) GROUP BY source
""")
def check_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.first_failure(check.check_files(*_installed(spark, sf_dir), CheckMode.FULL))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, md5(substr(text, 1, 0) || text) AS whole FROM documents")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "utf-8")
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", check.digest_of(data, size).alias("md5"), check.digest_of(data, size, "sha256").alias("sha256"), F.md5(F.concat(F.unhex(F.lit("")), data)).alias("whole"))


NEVR_SQL = "'pkg-' || source || '-' || CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 || ':' ELSE '' END || '1.' || doc_id || '-' || lang"


def _nevrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 5).cast("string"), F.lit(":"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("pkg-"), "source", F.lit("-"), epoch, F.lit("1."), "doc_id", F.lit("-"), "lang").alias("nevr"))


@query("SELECT doc_id, 'pkg-' || source AS name, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS epoch, '1.' || doc_id AS version, lang AS release FROM documents")
def nevr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nevrs(spark, sf_dir).select("doc_id", binary.nevr(F.col("nevr")).alias("n")).select("doc_id", "n.name", "n.epoch", "n.version", "n.release")


@query(f"SELECT doc_id AS delta_id, {NEVR_SQL} AS src_nevr, CASE WHEN doc_id % 4 <> 1 THEN doc_id END AS installed_id, CAST(CASE WHEN doc_id % 4 <> 1 THEN 0 ELSE 10 END AS INTEGER) AS status FROM documents")
def installed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _nevrs(spark, sf_dir)
    have = named.where("doc_id % 4 <> 1").select("doc_id", binary.nevr(F.col("nevr")).alias("n"))
    twice = have.select(F.col("doc_id").alias("installed_id"), "n.*").unionByName(have.select((F.col("doc_id") + 10**9).alias("installed_id"), "n.*"))
    return check.installed_for(named.select(F.col("doc_id").alias("delta_id"), F.col("nevr").alias("src_nevr")), twice)


@query(f"SELECT doc_id, {NEVR_SQL} || '-' || md5(text) AS text, {NEVR_SQL} AS nevr, md5(text) AS sequence FROM documents")
def sequence_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nevrs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5("text")).alias("raw")), "doc_id")
    made = rows.select("doc_id", sequence.sequence_id(F.col("nevr"), F.col("raw")).alias("text"))
    return made.withColumn("s", sequence.split_sequence_id(F.col("text"))).select("doc_id", "text", "s.nevr", "s.sequence")


# -- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, lower(printf('%08x', event_id)) AS be32, event_id AS again, event_id % 8192 AS rest, CAST(event_id // 8192 AS BIGINT) AS block, (4 - event_id % 4) % 4 AS pad, -(event_id % 1000) AS signed FROM events")
def be32_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    negative = -(n % 1000)
    return table(spark, sf_dir, "events").select(
        "event_id", _hex(binary.be(n)).alias("be32"), binary.from_be(binary.be(n)).alias("again"), (n % 8192).alias("rest"), binary.block_id(n).alias("block"), binary.padding(n, 4).alias("pad"),
        binary.from_sign_magnitude(binary.sign_magnitude(negative)).alias("signed"),
    )


@query("SELECT doc_id, lower(hex(encode(text))) AS digits, text AS again FROM documents")
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = binary.hex_lower(F.encode("text", "utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", digits.alias("digits"), F.decode(binary.from_hex(F.concat(digits, F.lit("f"))), "utf-8").alias("again"))


def _codec(name: str, comp: Compression) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = codecs.compressed(F.encode("text", "utf-8"), int(comp))
        rows = table(spark, sf_dir, "documents").select("doc_id", packed.alias("packed"))
        back = codecs.decompressed(F.col("packed"), int(comp) if comp == Compression.NONE else None)
        return rows.select("doc_id", F.decode(back, "utf-8").alias("text"), codecs.sniffed(F.col("packed")).alias("codec"))

    run.__name__ = f"codec_roundtrip_{name}"
    query(f"SELECT doc_id, text, CASE WHEN {int(comp)} <> 0 OR strlen(text) >= 8 THEN {int(comp)} END AS codec FROM documents")(run)


for _comp in (Compression.NONE, Compression.GZIP, Compression.BZIP2, Compression.LZMA, Compression.XZ, Compression.LZIP, Compression.ZSTD):
    _codec(_comp.name.lower(), _comp)


@query("SELECT * FROM (VALUES (0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 1, 1), (4, 2, 2), (5, 3, 5), (6, 4, 6), (7, 6, 7)) t(disk, comp, again)")
def comp_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    to_api = F.create_map(*[F.lit(int(x)) for pair in DISK_CODES.items() for x in pair])
    to_disk = F.create_map(*[F.lit(int(x)) for pair in TO_DISK.items() for x in pair])
    codes = spark.range(len(DISK_CODES)).select(F.col("id").cast("int").alias("disk"))
    return codes.withColumn("comp", to_api[F.col("disk")]).withColumn("again", to_disk[F.col("comp")])


@query("""
SELECT * FROM (VALUES (0, 'no error'), (1, 'memory allocation error'), (2, 'bad arguments'), (3, 'I/O error'), (4, 'wrong file format'), (5, 'misconfigured external library'),
  (6, 'unspecified/unknown error'), (7, 'file too large'), (8, 'internal programming error'), (9, 'file changed'), (10, 'old RPM not installed'), (11, '(undefined error value)')) t(code, message)
""")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.create_map(*[F.lit(x) for i in range(11) for x in (i, strerror(i))])
    codes = spark.range(12).select(F.col("id").cast("int").alias("code"))
    return codes.withColumn("message", F.coalesce(F.try_element_at(messages, F.col("code")), F.lit(strerror(-1))))


# -- packages and containers ----------------------------------------------------------------------------------------------


def _packages(spark: SparkSession, sf_dir: str, comp: int = Compression.NONE, further: bool = False) -> DataFrame:
    """``(pair_id, old, new)``: both documents of a pair as packages, one after the other where they lie."""
    pairs = prefix_pairs(spark, sf_dir)
    new = make.wrap_archives(pairs, "pair_id", "new", comp, further, keep=("old",)).withColumnRenamed("package", "new")
    return make.wrap_archives(new, "pair_id", "old", comp, further, keep=("new",)).withColumnRenamed("package", "old")


def _container(name: str, options: MakeOptions, comp: int = Compression.NONE, further: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make.make_table(_packages(spark, sf_dir, comp, further), options, keep=("old", "new")).select("pair_id", "old", "new", F.col("result").alias("delta"))
        done = make.apply_table(made, keep=("new", "delta"))
        facts = F.struct("pair_id", "status", (F.col("result") == F.col("new")).alias("same"), F.md5("new").alias("md5")).alias("facts")
        view = deltas.info(deltas.parse_files(done.select("pair_id", "delta", facts), "pair_id", "delta", keep=("facts",)), keep=("facts",))
        return view.select("facts.pair_id", "facts.status", "facts.same", "version", "type", "src_nevr", (F.col("facts.md5") == F.col("tgt_md5")).alias("digest"), "tgt_comp")

    run.__name__ = name
    sql = PREFIX + f"SELECT pair_id, 0 AS status, TRUE AS same, {options.version} AS version, {int(options.type)} AS type, 'data-' || pair_id || '-1' AS src_nevr, TRUE AS digest, {int(comp)} AS tgt_comp FROM pairs"
    query(sql)(run)


_container("container_roundtrip_v1", MakeOptions().with_version(1).with_delta_comp(Compression.GZIP))
_container("container_roundtrip_v2", MakeOptions().with_version(2).with_delta_comp(Compression.BZIP2))
_container("container_roundtrip_v3", MakeOptions().with_delta_comp(Compression.XZ).with_addblk_comp(Compression.ZSTD))
_container("container_roundtrip_rpmonly", MakeOptions().with_type(DeltaType.RPMONLY).with_delta_comp(Compression.ZSTD).without_addblk())
# several files and compressed payloads: the archive is altered before it is compared
_container("container_roundtrip_files", MakeOptions().with_delta_comp(Compression.GZIP), further=True)
_container("container_roundtrip_gzip", MakeOptions(), Compression.GZIP, further=True)
_container("container_roundtrip_bzip2", MakeOptions().with_version(1), Compression.BZIP2, further=True)
_container("container_roundtrip_xz", MakeOptions(), Compression.XZ, further=True)
_container("container_roundtrip_rpmonly_gzip", MakeOptions().with_type(DeltaType.RPMONLY), Compression.GZIP, further=True)


def _installed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, header, delta, sequence, files, new)``: some packages or files are missing, some packages are others, some files longer or changed."""
    pairs = prefix_pairs(spark, sf_dir)
    made = make.make_table(_packages(spark, sf_dir, Compression.GZIP, True), MakeOptions(), keep=("old", "new")).select("pair_id", "old", "new", F.col("result").alias("delta"))
    text = deltas.parse_files(made, "pair_id", "delta", keep=("pair_id", "old", "new", "delta")).select(
        "pair_id", "old", "new", "delta", sequence.sequence_id(F.col("src_nevr"), F.col("sequence")).alias("sequence")
    )
    header = F.when(F.col("pair_id") % 5 == 0, F.lit(None)).otherwise(F.col("old"))
    n, old = F.col("pair_id"), F.col("old")
    content = F.when(n % 11 == 0, F.concat(old, F.lit("x").cast("binary"))).when(n % 13 == 0, F.concat(F.lit("x").cast("binary"), F.substring(old, 2, F.octet_length(old)))).otherwise(old)
    files = pairs.where(n % 17 != 0).select("pair_id", F.lit("/data/file").alias("path"), content.alias("content"))
    return make.with_files(text.withColumn("header", header), files)


INSTALLED = PREFIX + """, s AS (SELECT pair_id, strlen(old) > 0 AS full, old, new, CASE WHEN pair_id % 5 = 0 THEN 10 WHEN strlen(old) > 0 AND pair_id % 17 = 0 THEN 3
   WHEN strlen(old) > 0 AND pair_id % 11 <> 0 AND pair_id % 13 = 0 AND substr(old, 1, 1) <> 'x' THEN 9 ELSE 0 END AS status FROM pairs)
"""


@query(INSTALLED + "SELECT pair_id, status FROM s")
def check_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas against installed packages and their files."""
    return make.check_table(_installed_packages(spark, sf_dir), CheckMode.FULL)


@query(INSTALLED + "SELECT pair_id, status FROM s")
def check_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the text of the deltas' sequences."""
    return make.check_sequence_table(_installed_packages(spark, sf_dir), CheckMode.FULL)


@query(INSTALLED + "SELECT pair_id, CASE WHEN status = 9 THEN NULL ELSE status END AS status, CASE WHEN status = 0 THEN TRUE END AS same FROM s")
def apply_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages made from installed files; what a changed file makes of them depends on whether it is copied from, but it is never the wrong package."""
    done = make.apply_installed_table(_installed_packages(spark, sf_dir), keep=("new",))
    same = F.col("result") == F.col("new")
    n = F.col("pair_id")
    doubtful = (n % 5 != 0) & (n % 17 != 0) & (n % 11 != 0) & (n % 13 == 0) & ((F.col("status") == 9) | same)
    return done.select("pair_id", F.when(~doubtful, F.col("status")).alias("status"), F.when(~doubtful, same).alias("same"))


@query("""
SELECT doc_id, 'data-' || doc_id || '-1' AS nevr, FALSE AS is_source, 1 AS comp, 9 AS level, 'cpio' AS format, 5 AS n_files, TRUE AS adds_up, TRUE AS digested, 124 AS longest FROM documents
""")
def package_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packages of all documents say of themselves."""
    docs = table(spark, sf_dir, "documents")
    packed = make.wrap_archives(docs, "doc_id", "text", Compression.GZIP, True)
    facts = make.package_facts(packed, "doc_id", "package").join(packed.select("doc_id", F.octet_length("package").alias("bytes")), "doc_id")
    return facts.select(
        "doc_id", "nevr", "is_source", "comp", "level", F.decode("format_at", "utf-8").alias("format"), "n_files", ((F.col("size") == F.col("bytes")) & (F.col("head_size") + F.col("archive_size") == F.col("size"))).alias("adds_up"),
        F.col("signature_md5").isNotNull().alias("digested"), F.col("longest_header").cast("int").alias("longest"),
    )


@query(PREFIX + "SELECT pair_id, 3 AS version, 1 AS type, 2 AS comp, 'data-' || pair_id || '-1' AS tgt_nevr, TRUE AS even, TRUE AS within, TRUE AS unsigned, TRUE AS header FROM pairs")
def info_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = MakeOptions().with_type(DeltaType.RPMONLY).with_delta_comp(Compression.BZIP2, 7)
    made = make.make_table(_packages(spark, sf_dir), options)
    view = deltas.info(deltas.parse_files(made.select(F.col("pair_id").cast("string").alias("path"), F.col("result").alias("content"))))
    inserted = F.aggregate(F.transform("int_copies", lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    return view.select(
        F.col("filename").cast("long").alias("pair_id"), deltas.get_uint(1).cast("int").alias("version"), deltas.get_uint(2).cast("int").alias("type"), deltas.get_uint(3).cast("int").alias("comp"),
        deltas.get_string(6).alias("tgt_nevr"), ((F.size(deltas.get_ulong_array(15)) % 2 == 0) & (F.size(deltas.get_ulong_array(16)) % 2 == 0)).alias("even"), (inserted <= deltas.get_ullong(18)).alias("within"),
        F.coalesce(F.forall(deltas.get_ulong_array(16), lambda x: (x >= 0) & (x < 2**32)), F.lit(True)).alias("unsigned"), (deltas.get_ulong(11) > 0).alias("header"),
    )
