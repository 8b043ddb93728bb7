"""Can a delta be applied to what is installed?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codes import CheckMode, Status
from ..functions.binary import nevr


def digest_of(content: Column, size: Column, algorithm: str = "md5") -> Column:
    """Hex digest of the first ``size`` bytes."""
    head = F.substring(content, F.lit(1), size.cast("int"))
    return F.md5(head) if algorithm == "md5" else F.sha2(head, 256)


def filesize_status(wanted: Column, found: Column) -> Column:
    """OK for equal sizes, NOINSTALL where there is no file, else MISMATCH."""
    return F.when(found.isNull(), int(Status.NOINSTALL)).when(found == wanted, int(Status.OK)).otherwise(int(Status.MISMATCH))


def content_status(wanted_size: Column, wanted_digest: Column, content: Column, algorithm: str = "md5") -> Column:
    """IO where there is no file; OK if its first bytes have the digest (more may follow), else MISMATCH."""
    return (
        F.when(content.isNull(), int(Status.IO))
        .when((F.octet_length(content) >= wanted_size) & (digest_of(content, wanted_size, algorithm) == F.lower(wanted_digest)), int(Status.OK))
        .otherwise(int(Status.MISMATCH))
    )


def check_files(manifest: DataFrame, found: DataFrame, mode: CheckMode, algorithm: str = "md5") -> DataFrame:
    """``(delta_id, pos, path, status)`` of manifest rows ``(delta_id, pos, path, size, digest)`` against ``(path, size, content)``.

    Files that should be empty are not looked at.
    """
    both = manifest.alias("m").join(found.select("path", F.col("size").alias("found_size"), "content").alias("f"), "path", "left")
    if mode == CheckMode.NONE:
        status = F.lit(int(Status.OK))
    elif mode == CheckMode.FILESIZES:
        status = filesize_status(F.col("size"), F.col("found_size"))
    else:
        status = content_status(F.col("size"), F.col("digest"), F.col("content"), algorithm)
    return both.select("delta_id", "pos", "path", F.when(F.col("m.size") == 0, int(Status.OK)).otherwise(status).alias("status"))


def first_failure(checked: DataFrame) -> DataFrame:
    """``(delta_id, status, failed)``: the status of the first file that fails, and how many do."""
    bad = F.col("status") != int(Status.OK)
    return checked.groupBy("delta_id").agg(
        F.coalesce(F.min_by(F.when(bad, F.col("status")), F.when(bad, F.col("pos"))), F.lit(int(Status.OK))).alias("status"), F.count_if(bad).alias("failed")
    )


def installed_for(deltas: DataFrame, installed: DataFrame) -> DataFrame:
    """``(delta_id, src_nevr, installed_id, status)``: the first installed package of that name, epoch, version and release, NOINSTALL if none.

    ``installed`` has installed_id, name, epoch (null for none), version and release.
    """
    wanted = deltas.select("delta_id", "src_nevr", nevr(F.col("src_nevr")).alias("n"))
    have = installed.select("installed_id", "name", "epoch", "version", "release")
    same = (F.col("n.name") == F.col("name")) & F.col("n.epoch").eqNullSafe(F.col("epoch")) & (F.col("n.version") == F.col("version")) & (F.col("n.release") == F.col("release"))
    first = Window.partitionBy("delta_id").orderBy(F.col("installed_id").asc_nulls_last())
    status = F.when(F.col("n").isNull(), int(Status.ARGS)).when(F.col("installed_id").isNull(), int(Status.NOINSTALL)).otherwise(int(Status.OK))
    return wanted.join(have, same, "left").withColumn("row", F.row_number().over(first)).where("row = 1").select("delta_id", "src_nevr", "installed_id", status.alias("status"))


def verify(rebuilt: DataFrame) -> DataFrame:
    """``(pair_id, status)`` of ``(pair_id, new, tgt_md5, lead_len, signature_md5)``: MISMATCH unless the digest fits.

    An all-zero digest is none: then header and archive, what follows the first ``lead_len`` bytes, must have the
    digest of the signature, if that has one.
    """
    body = F.md5(F.substring("new", F.col("lead_len").cast("int") + 1, F.octet_length("new")))
    signed = F.col("signature_md5").isNull() | (body == F.lower(F.hex("signature_md5")))
    fits = F.when(F.hex("tgt_md5") == "0" * 32, signed).otherwise(F.md5("new") == F.lower(F.hex("tgt_md5")))
    return rebuilt.select("pair_id", F.when(fits, int(Status.OK)).otherwise(int(Status.MISMATCH)).alias("status"))


def sequence_matches(sequence: Column, signature_md5: Column) -> Column:
    """For an rpm-only delta its sequence must be the signature's digest: FORMAT without one, else OK or MISMATCH."""
    return F.when(signature_md5.isNull(), int(Status.FORMAT)).when(sequence == signature_md5, int(Status.OK)).otherwise(int(Status.MISMATCH))


def source_allowed(kind: Column, from_package: Column, is_source: Column) -> Column:
    """An rpm-only delta, or one of a source package, cannot be applied from the file system."""
    return F.when(~from_package & ((kind == 1) | is_source), int(Status.ARGS)).otherwise(int(Status.OK))
