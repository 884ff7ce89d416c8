"""The steps as commands: ``marginalia <step> ...`` or ``python -m marginalia <step> ...``.

On a cluster, install the package where executors run, or send it with
``--py-files``; see the README.
"""

from __future__ import annotations

import argparse

from marginalia import fixed_values as fv
from marginalia.operators.analysis import AnalysisParams
from marginalia.operators.relational import with_ordinal
from marginalia.plans import contrast as contrast_plan
from marginalia.plans import corpus, extraction
from marginalia.session import build_session
from marginalia.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    top.add_argument("--scratch", help="folder all executors share, for intermediate tables")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        sub = steps.add_parser(name, help=text)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    step("discover", "links of list pages to a sorted URL list", "pages", "out").add_argument(
        "--css-class", default=fv.BOOK_LINK_CLASS
    )
    step("deduplicate", "attempt log to one URL per work", "attempts", "out").add_argument("--fallback")
    verify = step("verify", "check the next batch of URLs", "urls", "pages", "ledger")
    verify.add_argument("--batch", type=int, default=fv.BATCH_SIZE)
    verify.add_argument("--seed", type=int, default=0)
    extract = step("extract", "keyword reviews and book summary", "urls", "pages", "reviews-out", "summary-out")
    for sub in (verify, extract):
        sub.add_argument("--keyword", default=fv.KEYWORD)
    step("repair", "repair book names of a table", "table", "out").add_argument(
        "--kind", choices=("reviews", "summary"), required=True
    )
    contrast = step("contrast", "map, discriminant scores and density curves", "reviews", "summary", "cache", "out")
    contrast.add_argument("--epochs", type=int, default=20)
    contrast.add_argument("--approximate", action="store_true", help="find neighbours by descent, for very many texts")
    contrast.add_argument("--latent", type=int, default=0, help="latent axes fitted to the texts; 0 for hashed words")
    contrast.add_argument("--probes", type=int, default=0, help="cells to search per text; 0 for all that matter (exact)")
    contrast.add_argument("--needle", default=fv.AUTHOR_NEEDLE, help="part of the name of the author to contrast")
    contrast.add_argument("--split-date", default=fv.SPLIT_DATE)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    scratch = {"spark__checkpoint__dir": args.scratch} if args.scratch else {}
    spark = build_session(f"marginalia {args.step}", **scratch)
    if args.step == "discover":
        corpus.discover(readers.read_pages(spark, args.pages), args.out, args.css_class)
    elif args.step == "deduplicate":
        fallback = spark.read.parquet(args.fallback) if args.fallback else None
        corpus.deduplicate(spark.read.parquet(args.attempts), fallback, args.out)
    elif args.step == "verify":
        pages = readers.read_pages(spark, args.pages)
        corpus.verify_batch(spark, args.urls, pages, args.ledger, args.batch, args.seed, args.keyword).show()
    elif args.step == "extract":
        urls, pages = readers.read_url_list(spark, args.urls), readers.read_pages(spark, args.pages)
        wrote = extraction.extract_to_csv(urls, pages, args.reviews_out, args.summary_out, keyword=args.keyword)
        print(f"reviews written: {wrote[0]}, summary written: {wrote[1]}")
    elif args.step == "repair":
        print(f"rows with a bad name: {extraction.repair_csv(spark, args.table, args.out, args.kind)}")
    elif args.step == "contrast":
        result = contrast_plan.contrast(
            readers.read_reviews_csv(spark, args.reviews),
            with_ordinal(readers.read_summary_csv(spark, args.summary)),
            args.cache,
            epochs=args.epochs,
            params=AnalysisParams(author_needle=args.needle, split_date=args.split_date),
            probes=args.probes or None,
            approximate=args.approximate,
            latent=args.latent or None,
        )
        writers.write_map_points(result.points, f"{args.out}/map_points")
        for name in ("author_scores", "author_density", "period_scores", "period_density"):
            getattr(result, name).write.parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
