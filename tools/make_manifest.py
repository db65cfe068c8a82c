"""Record the double-typed output columns of every registered query (from the Spark schema, no execution)."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


from eventimpact.session import get_spark  # noqa: E402


def main():
    from eventimpact.plans import registry
    registry.load_all()
    spark = get_spark("local[4]", shuffle_partitions=4)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    p = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "eventimpact", "plans", "output_schemas.json")
    only = sys.argv[2:]                                     # keys to record anew; all if none are given
    out = json.load(open(p)) if only else {}
    for k, fn in sorted(registry.QUERIES.items()):
        if only and k not in only:
            continue
        try:
            sch = fn(spark, sf).schema
        except Exception as ex:
            print("skip", k, repr(ex)[:200])
            continue
        out[k] = [[f.name, f.dataType.simpleString()] for f in sch.fields]
    json.dump(out, open(p, "w"), indent=1, sort_keys=True)
    print(f"{len(out)} schemas")


if __name__ == "__main__":
    main()
