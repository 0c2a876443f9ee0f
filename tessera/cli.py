"""Command line: create, extract, list, get, cat, diff, header, validate, hash, redact, index, search, version.

Exit codes: 0 done, 1 failed, 2 wrong usage, 65 invalid data, 69 unsupported.
"""

from __future__ import annotations

import argparse
import os
import sys

OK, FAILED, USAGE, BAD_DATA, UNSUPPORTED = 0, 1, 2, 65, 69
VERSION = "0.1.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--stopwatch", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args):
        c = sub.add_parser(name)
        for flags, options in args:
            c.add_argument(*flags, **options)
        return c

    o = lambda *flags, **options: (flags, options)
    yes = {"action": "store_true"}
    add("create", o("archive"), o("inputs", nargs="*"), o("-c", "--compression", default="zstd"), o("--compression-level", type=int, default=-1), o("--single-file", **yes), o("--block-size", type=int, default=1 << 20), o("-f", "--force", **yes), o("-T", "--files-from"), o("-C", "--directory"), o("--checksum", default="h64"), o("--no-checksum", **yes), o("--no-posix", **yes), o("--no-hashes", **yes), o("--dedup", **yes), o("--no-metadata-compression", **yes), o("--name-format"))
    add("extract", o("archive"), o("names", nargs="*"), o("-o", "--output", default="."), o("--strip-components", type=int, default=0), o("-T", "--files-from"))
    add("list", o("archive"), o("--table", **yes), o("--format", choices=["plain", "json"], default="plain"), o("--header", **yes))
    add("get", o("archive"), o("names", nargs="+"), o("-o", "--output"), o("--json", **yes))
    add("cat", o("archive"), o("names", nargs="*"), o("--all", **yes), o("-o", "--output"), o("--fmt", choices=["raw", "json"], default="raw"))
    add("diff", o("old"), o("new"), o("-d", "--delta", **yes))
    add("header", o("archive"))
    add("validate", o("archive"), o("-v", "--verbose", **yes))
    add("hash", o("archive"), o("-a", "--algorithm", choices=["h64", "md5", "sha256", "blake3"], default="h64"))
    add("redact", o("archive"), o("names", nargs="*"), o("-o", "--output"), o("-I", "--in-place", **yes), o("-T", "--files-from"), o("-f", "--force", **yes))
    add("index", o("archive"), o("--type", default="minhash"), o("--with", dest="options", action="append", default=[]), o("-o", "--output"), o("--align", type=int, default=0))
    add("search", o("archive"), o("query", nargs="?"), o("-i", "--index"), o("--with", dest="options", action="append", default=[]))
    add("version")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()


def _pairs(options: list[str]) -> dict[str, str]:
    out = {}
    for x in options:
        k, eq, v = x.partition("=")
        if not eq:
            raise SystemExit(USAGE)
        out[k] = v
    return out


def _names(args) -> list[str]:
    names = list(getattr(args, "names", None) or getattr(args, "inputs", None) or [])
    if getattr(args, "files_from", None):
        f = sys.stdin if args.files_from == "-" else open(args.files_from, encoding="utf-8")
        names += [x.rstrip("\n") for x in f if x.rstrip("\n")]
    return names


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    import time

    from .functions.fmt import format_duration
    from .operators.content import ContentError
    from .sources.nametable import FormatError

    began = time.time()
    try:
        return _run(args)
    except FormatError as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_DATA
    except (NotImplementedError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return UNSUPPORTED
    except (OSError, ContentError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED
    finally:
        if args.stopwatch:
            print(format_duration(time.time() - began), file=sys.stderr)


def _run(args) -> int:
    if args.command == "version":
        print(VERSION)
        return OK
    from pyspark.sql import functions as F

    from .functions import fmt, hashing
    from .operators import archive as ar
    from .operators import content, diffing, listing, minhash
    from .sources import container, datasource, sidecar

    if args.command == "create":
        names = _names(args)
        if not names:
            return USAGE
        spark = _session()
        base = args.directory or "."
        parts = [datasource.walk(spark, os.path.join(base, n), os.path.normpath(n) if os.path.normpath(n) != "." else "") for n in names if _exists(os.path.join(base, n))]
        entries = parts[0]
        for p in parts[1:]:
            entries = entries.unionByName(p)
        out = os.path.abspath(args.archive)
        options = ar.WriteOptions(codec=args.compression, level=args.compression_level, checksum="none" if args.no_checksum else args.checksum, multiblock=not args.single_file, block_size=args.block_size, posix=not args.no_posix, hashes=not args.no_hashes, dedup=args.dedup, compress_meta=not args.no_metadata_compression, name_format=args.name_format)
        datasource.write_container(ar.build_archive(entries, options), out, args.force)
        return OK
    if args.command == "hash":
        with open(args.archive, "rb") as f:
            data = f.read()
        import hashlib

        digest = {"h64": lambda: f"{int(hashing.h64([data])[0]):016x}", "md5": lambda: hashlib.md5(data).hexdigest(), "sha256": lambda: hashlib.sha256(data).hexdigest(), "blake3": lambda: hashing.blake3([data])[0].hex()}[args.algorithm]()
        print(digest)
        return OK
    if args.command == "diff":
        container.open_container(args.old)
        container.open_container(args.new)
        spark = _session()
        d = diffing.diff_files(datasource.read_container(spark, args.old).files, datasource.read_container(spark, args.new).files)
        if args.delta:
            for r in diffing.diff_lines(d).orderBy("path").toLocalIterator():
                print(r.line)
        else:
            got = {r.status: (r.n_files, r.n_bytes) for r in diffing.diff_stats(d).collect()}
            for s in ("added", "deleted", "modified", "unchanged"):
                n, size = got.get(s, (0, 0))
                print(f"{s}: {n} files, {size or 0} bytes")
        return OK
    m = container.open_container(args.archive)
    if args.command == "header":
        print(f"version {'.'.join(map(str, m.header.version))}\nfiles {len(m.files)}\nblocks {len(m.blocks)}\nnames {m.name_format.name.lower()}\nindex {m.header.index_type.name.lower()}\nmetadata {m.header.meta_codec} {m.header.meta_stored}")
        return OK
    spark = _session()
    at = datasource.read_container(spark, args.archive)
    if args.command == "list":
        f = listing.list_table(at.files) if args.table else listing.list_json(at.files) if args.format == "json" else listing.list_plain(at.files)
        for r in f.orderBy("file_id").toLocalIterator():
            print(r.line)
        if args.header:
            t = listing.totals(at.files).first()
            print(f"{t.n_entries} entries, {t.total_size} bytes")
    elif args.command == "extract":
        content.extract(at, args.output, _names(args) or None, args.strip_components)
    elif args.command in ("get", "cat"):
        names = None if args.command == "cat" and args.all else args.names
        if names is not None and not names:
            return USAGE
        wanted = None if names is None else content.request(spark, names)
        if wanted is not None:
            lost = [r.name for r in content.missing(at.files, wanted).collect()]
            if lost:
                raise content.ContentError(f"not in the archive: {', '.join(lost)}")
            bad = content.find(at.files, wanted).filter("entry_type <> 'file'").select("name").limit(1).collect()
            if bad:
                raise content.ContentError(f"not a regular file: {bad[0].name}")
        if args.output and args.command == "cat" and args.fmt == "raw":
            content.cat(at, os.path.abspath(args.output), wanted)
            return OK
        data = content.read_files(at, wanted)
        plan = content.cat_plan(at.files, wanted).select("pos", "name")
        as_json = getattr(args, "json", False) or getattr(args, "fmt", "raw") == "json"
        rows = plan.join(data, "name").orderBy("pos")
        out = open(args.output, "wb") if args.output else sys.stdout.buffer
        if as_json:
            line = rows.select("pos", F.concat(F.lit('{"filename": "'), fmt.json_bytes(F.encode("name", "UTF-8")), F.lit('", "contents": "'), fmt.json_bytes(F.col("content")), F.lit('"}')).alias("line")).orderBy("pos")
            out.write(b"[" + b",\n".join(r.line.encode() for r in line.toLocalIterator()) + b"]\n")
        else:
            for r in rows.toLocalIterator():
                out.write(bytes(r.content))
        out.flush()
    elif args.command == "validate":
        bad = content.validate(at).filter("NOT valid").orderBy("block_id").collect()
        for r in bad if args.verbose else []:
            print(f"block {r.block_id}: {r.reason}")
        if not args.quiet:
            print("invalid" if bad else "valid")
        return FAILED if bad else OK
    elif args.command == "redact":
        names = _names(args)
        if not names or bool(args.output) == args.in_place:
            return USAGE
        out = args.archive if args.in_place else args.output
        if not args.in_place and os.path.exists(out) and not args.force:
            raise FileExistsError(out)
        o = ar.WriteOptions(codec="none", posix=m.posix is not None, hashes=m.hashes is not None, hash_algo=m.hash_algo.name.lower() if m.hash_algo else "sha256", compress_meta=False, name_format=m.name_format.name.lower(), align_log2=m.header.align_log2, multiblock=m.header.index_type == 0)
        datasource.write_container(content.redact(at, names).with_(options=o), out, True)
    elif args.command == "index":
        if args.type not in minhash.INDEXERS:
            raise RuntimeError(f"unsupported index type: {args.type}")
        given = _pairs(args.options)
        n, width, seed = int(given.get("hashes", 128)), int(given.get("bit_width", 64)), int(given.get("seed", 42))
        body = at.files.select("file_id", "name", "entry_type").join(content.read_files(at).select("file_id", "content"), "file_id", "left")
        rows = minhash.build(body, n, width, seed).orderBy("file_id").select("sketch").toLocalIterator()
        import numpy as np

        sketches = np.array([r.sketch for r in rows], np.int64).reshape(-1, n).view(np.uint64)
        s = sidecar.Sidecar(sidecar.SidecarType.MINHASH, args.archive, sidecar.archive_digest(args.archive), align_log2=args.align)
        s.sections[1] = sidecar.pack_sketches(n, width, seed, sketches)
        sidecar.write_sidecar(args.output or args.archive + ".index", s)
    elif args.command == "search":
        s = sidecar.read_sidecar(args.index or args.archive + ".index")
        if s is None:
            raise OSError("no index")
        if s.archive_hash != sidecar.archive_digest(args.archive):
            print("warning: the index belongs to another state of the archive", file=sys.stderr)
        given = _pairs(args.options)
        if "file" not in given and not args.query:
            return USAGE
        n, width, seed, _ = sidecar.unpack_sketches(s.sections[1])
        datasource.register(spark)
        index = spark.read.format("tessera_index").load(os.path.abspath(args.index or args.archive + ".index")).join(at.files.select("file_id", "name"), "file_id")
        if "file" in given:
            query: bytes | str = given["file"]
        else:
            with open(args.query, "rb") as f:
                query = f.read()
        top = int(given["topN"]) if "topN" in given else None
        for r in minhash.MinHashSearcher().search(index, query, top).collect():
            print(f"{r.score:.4f} {r.name}")
    return OK


def _exists(path: str) -> bool:
    if not os.path.lexists(path):
        raise FileNotFoundError(path)
    return True


if __name__ == "__main__":
    sys.exit(main())
