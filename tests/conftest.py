import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kinweave.session import local_session, ship

    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


PROFILE = """profile_id string, canonical_person_id string, source_type string, url string, display_name string, aliases array<string>,
headline string, bio_text string, organizations array<struct<name:string,role:string,start_year:int,end_year:int>>,
education array<struct<institution:string,degree:string,graduation_year:int>>, locations array<string>, outbound_links array<string>,
topics array<string>, timestamps array<string>, raw_text string,
supporting_spans array<struct<field_name:string,snippet:string,start_char:int,end_char:int>>, metadata map<string,string>, ingested_at timestamp"""


@pytest.fixture(scope="session")
def make_profiles(spark):
    """Profiles from dicts; fields that aren't given are empty."""
    import datetime as dt

    names = [f.split()[0] for f in PROFILE.replace("\n", " ").replace("struct<name:string,role:string,start_year:int,end_year:int>", "s").replace("struct<institution:string,degree:string,graduation_year:int>", "s").replace("struct<field_name:string,snippet:string,start_char:int,end_char:int>", "s").replace("map<string,string>", "m").split(", ")]

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            base = {
                "profile_id": f"p{i:03}", "source_type": "github", "url": f"https://site{i}.example/", "display_name": "Ada Person", "aliases": [], "bio_text": "A bio.", "organizations": [], "education": [],
                "locations": [], "outbound_links": [], "topics": [], "timestamps": [], "raw_text": "raw", "supporting_spans": [("bio_text", "A bio.", 0, 5)], "metadata": {"seed_group": "stage1"}, "ingested_at": dt.datetime(2024, 1, 1),
            }
            base |= r
            if base["organizations"]:
                base["organizations"] = [o if isinstance(o, tuple) or o is None else (o, None, None, None) for o in base["organizations"]]
            out.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(out, PROFILE)

    return make
