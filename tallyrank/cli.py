"""python -m tallyrank.cli ingest|train|evaluate|smoke --store PATH --artifacts PATH [--from SF_DIR]"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .plans.artifacts import ArtifactStore
from .plans.service import Request, Service
from .plans.train import train
from .session import get_session
from .sources import adapters
from .sources.store import Store


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["ingest", "train", "evaluate", "smoke"])
    p.add_argument("--store", required=True)
    p.add_argument("--artifacts", required=True)
    p.add_argument("--from", dest="source", help="a folder of star-schema tables to ingest")
    p.add_argument("--clear", action="store_true")
    p.add_argument("--no-tune", action="store_true")
    p.add_argument("--k", type=int)
    p.add_argument("--segment")
    a = p.parse_args(args)
    spark = get_session()
    store, artifacts = Store(spark, a.store), ArtifactStore(spark, a.artifacts)
    if a.command == "ingest":
        if not a.source:
            p.error("ingest needs --from")
        if a.clear:
            store.clear()
        store.upsert_products(adapters.catalogue(spark, a.source))
        store.upsert_users(adapters.people(spark, a.source))
        store.insert_events(adapters.dense_events(spark, a.source))
        print(store.counts())
    elif a.command == "train":
        print(train(spark, store, artifacts, tune_weights=not a.no_tune))
    elif a.command == "evaluate":
        rows = Service(spark, store, artifacts).metrics()
        for column, value in (("k", a.k), ("segment", a.segment)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        rows.orderBy("segment", "k", F.desc("ndcg")).show(200, truncate=False)
    else:
        service = Service(spark, store, artifacts)
        print(service.status())
        user = service.model().cells.select("user_id").first().user_id
        service.recommend(Request([user])).select("rank", "product_id", "title", "score").show()
        service.trending().show()


if __name__ == "__main__":
    main()
