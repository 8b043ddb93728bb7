import dataclasses
import hashlib
import random

import pytest

from deltaframe.codes import CheckMode, Compression, DeltaError, DeltaType, Digest, MakeOptions, PayloadFormat, Status, from_disk, on_disk, strerror
from deltaframe.functions import codecs
from deltaframe.operators import archive, make, sequence
from deltaframe.sources import container, patches
from deltaframe.sources.package import Package, manifest_tags


def package(version, contents, source=False, compressor="none", epoch=None, extra=()):
    files, parts = [], []
    for i, (name, data) in enumerate(sorted(contents.items())):
        link = isinstance(data, str)
        mode = 0o120777 if link else 0o100644
        raw = data.encode() if link else data
        files.append(archive.File(name, mode, len(raw), md5="" if link else hashlib.md5(raw).hexdigest(), linkto=data if link else "", flags=1 if name in extra else 0))
        parts.append(archive.pack({"mode": mode, "ino": i + 1, "mtime": 7, "nlink": 1}, b"." + name.encode(), raw))
    payload = b"".join([*parts, archive.pack({"nlink": 1}, archive.TRAILER.encode())])
    packed = codecs.compress(payload, {"none": 0, "gzip": 1, "xz": 4}[compressor], 9)
    return Package.make("tool", version, "1.fc1", packed, epoch=epoch, compressor=compressor, source=source, files=manifest_tags(files)).encode()


RNG = random.Random(1)
OLD = {"/usr/bin/tool": RNG.randbytes(4000), "/usr/lib/a.so": b"shared " * 300, "/usr/share/doc": "../other", "/etc/tool.conf": b"setting=1\n" * 20}
NEW = {**OLD, "/usr/bin/tool": OLD["/usr/bin/tool"][:2000] + b"patched" + OLD["/usr/bin/tool"][2100:], "/usr/share/more": b"entirely new " * 9}


@pytest.mark.parametrize("version", [1, 2, 3])
@pytest.mark.parametrize("comp", [Compression.NONE, Compression.GZIP, Compression.BZIP2, Compression.LZMA, Compression.XZ, Compression.ZSTD])
def test_standard_round_trip(version, comp):
    old, new = package("1", OLD, extra=("/etc/tool.conf",)), package("2", NEW, epoch=3)
    for options in (MakeOptions().with_version(version).with_delta_comp(comp), MakeOptions().with_version(version).with_delta_comp(comp).without_addblk()):
        delta = make.make(old, new, options)
        assert make.apply(old, delta) == new
        parsed = container.parse(delta)
        assert (parsed.version, parsed.type, parsed.src_nevr, parsed.tgt_nevr) == (version, DeltaType.STANDARD, "tool-1-1.fc1", "tool-3:2-1.fc1")
        assert parsed.ext_copies
        assert len(parsed.int_data) < 2500


def test_rpmonly_identity_and_compressed_payloads():
    old, new = package("1", OLD, compressor="gzip"), package("2", NEW, compressor="xz")
    delta = make.make(old, new, MakeOptions().with_type(DeltaType.RPMONLY))
    parsed = container.parse(delta)
    assert (parsed.type, parsed.comp, parsed.tgt_comp, len(parsed.sequence)) == (DeltaType.RPMONLY, Compression.XZ, Compression.XZ, 16)
    header = container.parse(delta, body=False)
    assert (header.tgt_nevr, header.src_nevr) == ("tool-2-1.fc1", "")
    plain_old, plain_new = package("1", OLD), package("2", NEW)
    assert make.apply(plain_old, make.make(plain_old, plain_new, MakeOptions().with_type(1).without_addblk())) == plain_new
    alone = make.make(plain_old, None, MakeOptions().with_type(1))
    assert make.apply(plain_old, alone) == plain_old
    assert not container.parse(alone).ext_copies
    same = make.make(None, plain_new, MakeOptions().with_version(2).with_delta_comp(0))
    assert make.apply(plain_new, same) == plain_new


def test_errors():
    old, new = package("1", OLD), package("2", NEW)
    delta = make.make(old, new)
    cases = [(lambda: make.apply(new, delta), Status.MISMATCH), (lambda: make.apply(old, b"junk"), Status.FORMAT), (lambda: make.make(None, None), Status.ARGS),
             (lambda: make.make(old, new, MakeOptions().with_type(1).with_version(2)), Status.ARGS), (lambda: container.parse(delta[:-9]), Status.FORMAT),
             (lambda: MakeOptions().with_version(4), Status.ARGS), (lambda: MakeOptions().with_type(2), Status.ARGS), (lambda: MakeOptions().with_delta_comp(1, 10), Status.ARGS), (lambda: MakeOptions().with_patches("a", None), Status.ARGS),
             (lambda: codecs.decompress(b"LZIP\x01\x10" + bytes(30)), Status.FORMAT), (lambda: on_disk(Compression.LZIP, 1), Status.PROG), (lambda: from_disk(99), Status.FORMAT), (lambda: codecs.sniff(b"short"), Status.FORMAT),
             (lambda: codecs.decompress(b"\x1f\x8b" + bytes(20)), Status.FORMAT)]
    for step, status in cases:
        with pytest.raises(DeltaError) as e:
            step()
        assert e.value.status == status
    assert strerror(9) == "file changed"
    assert strerror(77) == "(undefined error value)"
    assert MakeOptions().without_addblk().with_addblk_comp(Compression.XZ).addblk


def test_container_of_edge_values():
    base = container.Delta(type=1, version=3, tgt_nevr="a-1-1", src_nevr="b-1-1", tgt_header_len=5, tgt_leadsig=bytes(112), int_data=b"xy", int_copies=[(2, 1), (0, 1)], ext_copies=[(10, 5), (-12, 2)], ext_data_len=15, off_adj=[(1, -7), (2, 2**31 - 1)], sequence=bytes(range(16)), add_data=b"add")
    again = container.parse(container.encode(base))
    assert dataclasses.replace(again, comp_level=base.comp_level) == base
    for bad in ({"ext_copies": [(10, 6)]}, {"ext_copies": [(-1, 5)]}, {"ext_copies": [(0, 0)]}, {"int_copies": [(2, 3)]}, {"sequence": bytes(17)}, {"tgt_header_len": 0}, {"tgt_leadsig": bytes(111)}):
        with pytest.raises(DeltaError):
            container.parse(container.encode(dataclasses.replace(base, **bad)))


@pytest.mark.parametrize("positions", [[], [0], [5], [0, 1, 2], list(range(3, 80)), [4, 5, 1, 2, 9], [0, 8, 9, 700, 3], [7, 6, 5], list(range(0, 40, 2))])
def test_sequence_codec(positions):
    assert sequence.decode_order(sequence.encode_order(positions), max(positions, default=0) + 1) == positions
    if positions:
        with pytest.raises(DeltaError):
            sequence.decode_order(sequence.encode_order(positions), max(positions))


def test_known_sequence():
    assert sequence.decode_order(bytes.fromhex("30"), 3) == [0, 1, 2]
    assert sequence.encode_order([0, 1, 2]) == bytes.fromhex("30")
    with pytest.raises(DeltaError):
        sequence.decode_order(b"\x18", 9)


def test_checks():
    old = package("1", OLD)
    delta = make.make(old, package("2", NEW))
    found = {k: v for k, v in OLD.items() if isinstance(v, bytes)}
    assert make.check(delta, old) == Status.OK
    assert make.check(delta, None) == Status.NOINSTALL
    assert make.check(delta, package("9", OLD)) == Status.MISMATCH
    for mode in (CheckMode.FULL, CheckMode.FILESIZES):
        assert make.check(delta, old, found, mode) == Status.OK
    longer = {**found, "/usr/lib/a.so": found["/usr/lib/a.so"] + b"x"}
    assert make.check(delta, old, longer, CheckMode.FULL) == Status.OK
    assert make.check(delta, old, longer, CheckMode.FILESIZES) == Status.MISMATCH
    gone = {k: v for k, v in found.items() if k != "/usr/bin/tool"}
    assert make.check(delta, old, gone, CheckMode.FULL) == Status.IO
    assert make.check(delta, old, gone, CheckMode.FILESIZES) == Status.NOINSTALL
    d = container.parse(delta)
    text = f"{d.src_nevr}-{d.sequence.hex()}\n"
    assert make.check_sequence(text, old) == Status.OK
    with pytest.raises(DeltaError):
        make.check_sequence("tool-1-1.fc1-abc", old)


def test_package_fields():
    p = Package.parse(package("1", OLD, compressor="xz", epoch=2))
    assert (p.nevr(), p.is_source(), p.compressor(), p.level(), p.digest_algorithm(), p.payload_format()) == ("tool-2:1-1.fc1", False, Compression.XZ, 9, Digest.MD5, PayloadFormat.CPIO)
    assert Package.parse(p.encode()) == p
    raw = p.header.encode()
    assert raw[p.payload_format_offset() :][:5] == b"cpio\0"
    assert {f.name: f.linkto for f in p.files()}["/usr/share/doc"] == "../other"
    assert Package.parse(package("1", OLD, source=True)).is_source()


def patch_list(name, evr, patched, records):
    s = lambda t: bytes([len(t)]) + t.encode()
    front = lambda t: bytes([0, len(t)]) + t.encode()
    out = b"RPML" + s(name) + s(evr) + s("host") + bytes(4) + len(patched).to_bytes(2, "big")
    if patched:
        out += b"".join(s("p") for _ in patched) + len(patched).to_bytes(4, "big") + b"".join(front(p) for p in patched)
    last = ""
    for path, mode, md5 in records:
        keep = len(last) if path.startswith(last) else 0
        out += bytes([keep, len(path) - keep]) + path[keep:].encode() + mode.to_bytes(2, "big") + b"\x00" + b"\x05" + md5
        last = path
    return out + bytes(2)


def test_sequence_of_other_makers():
    """The digest by hand: names without the first slash, device numbers of devices only."""
    files = [archive.File("/dev/a", 0o060600, rdev=0x0803), archive.File("/x", 0o100644, 2, md5="0" * 31 + "1", rdev=9), archive.File("/l", 0o120777, linkto="to", rdev=9), archive.File("/d", 0o040755, rdev=9)]
    raw = b"dev/a\0\0\0\x61\x80" + bytes(4) + b"\0\0\x08\x03" + b"x\0\0\0\x81\xa4\0\0\0\x02" + bytes(4) + bytes(15) + b"\x01" + b"l\0\0\0\xa1\xff\0\0\0\x02" + bytes(4) + b"to\0" + b"d\0\0\0\x41\xed" + bytes(8)
    assert make.sequence_digest(files, [0, 1, 2, 3]) == hashlib.md5(raw).digest()


def test_offset_adjustments():
    assert archive.shift_deltas([]) == []
    assert archive.shift_deltas([(100, 140), (300, 300)]) == [(100, 40), (200, -40)]
    most = 2**31 - 1
    assert archive.shift_deltas([(most + 5, most + 5 + 2**32)]) == [(most, 0), (5, most), (0, most), (0, 2)]
    old = package("1", OLD, extra=("/usr/bin/tool",))
    parsed = container.parse(make.make(old, package("2", NEW)))
    assert parsed.off_adj and (0, 0) not in parsed.off_adj
    kept = package("1", {"/a": b"same bytes " * 9})
    assert container.parse(make.make(kept, kept)).off_adj == []


def test_all_zero_digest_falls_back_to_the_signature():
    old, new = package("1", OLD), package("2", NEW)
    d = dataclasses.replace(container.parse(make.make(old, new)), tgt_md5=bytes(16))
    assert make.apply(old, container.encode(d)) == new
    other = Package.parse(new).with_archive(b"another").lead_and_signature()
    with pytest.raises(DeltaError) as e:
        make.apply(old, container.encode(dataclasses.replace(d, tgt_leadsig=other)))
    assert e.value.status == Status.MISMATCH


def test_only_regular_files_are_left_out_as_unpatched():
    files = [archive.File("/l", 0o120777, linkto="to"), archive.File("/f", 0o100644, 1, md5="0" * 32)]
    data = archive.pack({"mode": 0o120777, "nlink": 1}, b"./l", b"to") + archive.pack({"mode": 0o100644, "nlink": 1}, b"./f", b"x") + archive.pack({"nlink": 1}, archive.TRAILER.encode())
    assert archive.normalise(data, files, frozenset(("l", "f"))).positions == [0]


def test_apply_from_installed_files():
    old, new = package("1", OLD), package("2", NEW)
    delta = make.make(old, new)
    found = {k: v + b"more" for k, v in OLD.items() if isinstance(v, bytes)}
    header = Package.parse(old).encode(archive=False)
    assert make.apply_installed(header, delta, found) == new
    cases = [(lambda: make.apply_installed(None, delta, found), Status.NOINSTALL), (lambda: make.apply_installed(header, delta, {}), Status.IO), (lambda: make.apply_installed(new, delta, found), Status.MISMATCH),
             (lambda: make.apply_installed(header, delta, {**found, "/usr/lib/a.so": b"short"}), Status.MISMATCH), (lambda: make.apply_installed(header, make.make(old, new, MakeOptions().with_type(1)), found), Status.ARGS)]
    for step, status in cases:
        with pytest.raises(DeltaError) as e:
            step()
        assert e.value.status == status


@pytest.mark.parametrize("size", [0, 1, 70_000])
def test_lzip_members(size):
    raw = RNG.randbytes(size // 2) + b"a" * (size - size // 2)
    one = codecs.compress(raw, Compression.LZIP)
    assert codecs.sniff(one) == Compression.LZIP
    assert codecs.decompress(one) == raw
    assert codecs.decompress(one + codecs.compress(b"tail", Compression.LZIP)) == raw + b"tail"
    for bad in (one[:-1], one[:-20] + bytes(20), b"LZIP\x02" + one[5:]):
        with pytest.raises(DeltaError):
            codecs.decompress(bad)


def test_tables_of_odd_rows(spark):
    old, new = package("1", OLD), package("2", NEW)
    rows = [(1, old, new), (2, None, None), (3, b"junk", new), (4, None, new), (None, old, None)]
    made = make.make_table(spark.createDataFrame(rows, "pair_id int, old binary, new binary")).collect()
    assert sorted((str(r.pair_id), r.status) for r in made) == [("1", 0), ("2", Status.ARGS), ("3", Status.FORMAT), ("4", 0), ("None", 0)]
    deltas_ = spark.createDataFrame([(1, old, bytes(made[0].result)), (2, old, None), (3, None, b"x"), (4, old[:50], b"drpm" * 40)], "pair_id int, old binary, delta binary")
    assert {r.pair_id: r.status == 0 for r in make.apply_table(deltas_).collect()} == {1: True, 2: False, 3: False, 4: False}
    with pytest.raises(DeltaError):
        make.make_table(deltas_, MakeOptions().with_seqfile("x"))


def test_patch_lists():
    md5 = hashlib.md5(OLD["/usr/lib/a.so"]).digest()
    printed = patch_list("tool", "1-1.fc1", ["usr/bin/tool", "usr/lib/a.so"], [])
    patched = patch_list("tool", "1-1.fc1", [], [("./usr/lib", 0o100644, bytes(16)), ("./usr/lib/a.so", 0o100644, md5)])
    a, b = patches.read_patch_pair(printed, patched)
    assert [f.name for f in b.files] == ["usr/lib", "usr/lib/a.so"]
    names = {k.lstrip("/"): hashlib.md5(v).digest() for k, v in OLD.items() if isinstance(v, bytes)}
    assert patches.unpatched_names(a, b, names) == {"usr/bin/tool"}
    old, new = package("1", OLD), package("2", NEW)
    delta = make.make(old, new, lists=(printed, patched))
    files = Package.parse(old).files()
    kept = [files[i].name for i in sequence.decode_order(container.parse(delta).sequence[16:], len(files))]
    assert "/usr/bin/tool" not in kept
    assert make.apply(old, delta) == new
    with pytest.raises(DeltaError):
        make.make(old, new, lists=(patch_list("tool", "8-1", [], []),) * 2)


def test_sequence_files(tmp_path):
    old, new = package("1", OLD), package("2", NEW)
    for name, data in (("print", patch_list("tool", "1-1.fc1", ["usr/bin/tool"], [])), ("patch", patch_list("tool", "1-1.fc1", [], []))):
        (tmp_path / name).write_bytes(data)
    options = MakeOptions().with_seqfile(str(tmp_path / "seq")).with_patches(str(tmp_path / "print"), str(tmp_path / "patch"))
    delta = make.make(old, new, options)
    assert make.apply(old, delta) == new
    text = (tmp_path / "seq").read_text()
    assert text == f"tool-1-1.fc1-{container.parse(delta).sequence.hex()}\n"
    assert make.check_sequence(text, old) == Status.OK


def test_data_source_and_stream(spark, tmp_path):
    from deltaframe.sources import deltas
    from deltaframe.streaming.deltas import stream_deltas

    delta = make.make(package("1", OLD), package("2", NEW))
    deltas.register(spark)
    rows = spark.createDataFrame([("a.delta", delta), ("b.delta", b"junk")], "filename string, content binary")
    rows.write.format("deltafile").mode("append").save(str(tmp_path / "d"))
    for found in (spark.read.format("deltafile").load(str(tmp_path / "d")), deltas.read_deltas(spark, str(tmp_path / "d"))):
        got = {r.filename.rsplit("/", 1)[1]: r for r in found.collect()}
        assert (got["a.delta"].status, got["a.delta"].src_nevr, got["b.delta"].status, got["b.delta"].version) == (0, "tool-1-1.fc1", Status.FORMAT, None)
    deltas.write_sequences(deltas.read_deltas(spark, str(tmp_path / "d")).where("status = 0"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0].startswith("tool-1-1.fc1-")
    short = spark.read.format("deltafile").option("headerOnly", "true").load(str(tmp_path / "d")).where("status = 0").first()
    assert short.tgt_nevr == "tool-2-1.fc1"
    q = stream_deltas(spark, str(tmp_path / "d")).select("src_nevr", "status").writeStream.format("memory").queryName("deltas_seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deltas_seen").count() == 2
    with pytest.raises(DeltaError):
        deltas.get_uint(12)
