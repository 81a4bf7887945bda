import json

from tests.fixtures import SMALL_CAPTURE
from wiretally.__main__ import main
from wiretally.operators.ranking import GROUP_LIMIT


def test_whole_job_from_files(spark, tmp_path):
    (tmp_path / "normal.csv").write_text("10.0.0.5,10.0.0.6,10,TCP,6,50\n")
    (tmp_path / "attack.csv").write_text(SMALL_CAPTURE)
    (tmp_path / "blocks.csv").write_text(
        "network,geoname_id,latitude,longitude\n10.0.0.0/24,1,1.5,2.5\n"
    )
    (tmp_path / "places.csv").write_text("geoname_id,country_name,city_name\n1,Land,Town\n")
    arguments = [
        "--normal", str(tmp_path / "normal.csv"),
        "--attack", str(tmp_path / "attack.csv"),
        "--blocks", str(tmp_path / "blocks.csv"),
        "--locations", str(tmp_path / "places.csv"),
        "--packets", str(tmp_path / "packets"),
        "--report", str(tmp_path / "reports"),
    ]
    limit = spark.conf.get(GROUP_LIMIT)
    main([*arguments, "--run-id", "first", "--tables", str(tmp_path / "tables")])
    main([*arguments, "--run-id", "second", "--hosts", "1", "--pairs", "1"])

    assert spark.conf.get(GROUP_LIMIT) == limit

    stored = {
        document["run_id"]: document
        for path in (tmp_path / "reports" / "header").glob("*.json")
        for document in map(json.loads, path.read_text().splitlines())
    }
    assert sorted(stored) == ["first", "second"]
    assert len(stored["first"]["Map"]["attackDS"]) == 3
    assert len(stored["second"]["Map"]["attackDS"]) == 1
    (host,) = stored["second"]["BehaviorOfTopIP"]["attackBehaviorOfSource"]
    assert (host["IP"], host["Source"]["Country"]["name"]) == ("10.0.0.1", "Land")
    for name, n in (("series", 4), ("locations", 5), ("protocols", 12)):
        kept = spark.read.json(str(tmp_path / "reports" / name)).where("run_id = 'first'")
        assert kept.count() == n
    tables = {
        path.name: spark.read.parquet(str(path)).count() for path in (tmp_path / "tables").iterdir()
    }
    assert tables == {
        "top_src_packets": 4, "top_src_bytes": 4, "top_dst_packets": 3, "top_dst_bytes": 3,
        "rates": 4, "pairs": 4, "victims": 3, "map": 5,
    }
