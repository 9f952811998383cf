"""python -m lodestone ingest FOLDER --store DIR [--collection C] [--force] [--prune] | ask QUESTION... --store DIR [--collection C] | stats --store DIR"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("command", choices=["ingest", "ask", "stats", "clear-cache"])
    parser.add_argument("what", nargs="*", help="a folder, or questions")
    parser.add_argument("--store", required=True)
    parser.add_argument("--collection", default="default")
    parser.add_argument("--force", action="store_true", help="load unchanged files too")
    parser.add_argument("--prune", action="store_true", help="delete files that are gone")
    parser.add_argument("--mode", choices=["doc_qa", "summarize_document", "compare_documents"])
    args = parser.parse_args(argv)
    if bool(args.what) != (args.command in ("ingest", "ask")):
        parser.error("ingest takes a folder, ask takes questions, the others take nothing")

    from pyspark.sql import SparkSession

    from lodestone.operators.registry import Store
    from lodestone.plans import ingestion
    from lodestone.plans.service import Options
    from lodestone.plans.shipping import ship

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    ship(spark)
    store = Store(spark, args.store, args.collection)
    if args.command == "ingest":
        for folder in args.what:
            for r in ingestion.ingest_directory(store, folder, force=args.force, prune=args.prune).orderBy("source").toLocalIterator():
                print(f"{r.status}\t{r.source}\t{r.num_chunks}")
    elif args.command == "ask":
        asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(args.what)], "request_id string, text string")
        for r in ingestion.opened(store).ask(asked, Options(mode=args.mode)).orderBy("request_id").toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    elif args.command == "stats":
        print(json.dumps(ingestion.stats(store)))
    else:
        print(ingestion.clear_cache(store))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
