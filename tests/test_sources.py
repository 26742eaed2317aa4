import json

from oddspark.operators import baskets as B
from oddspark.operators import facts as X
from oddspark.operators import lookup, scoring
from oddspark.sources import files, reports, sinks


def _report(rid, date, drugs, reactions, **flags):
    return {
        "safetyreportid": rid, "receiptdate": date, **flags,
        "patient": {
            "drug": [
                {"medicinalproduct": n, "drugcharacterization": role, "drugindication": "Pain", "openfda": {"pharm_class_epc": [c], "generic_name": [n]}}
                for n, c, role in drugs
            ],
            "reaction": [{"reactionmeddrapt": r} for r in reactions],
        },
    }


def test_nested_reports(spark, tmp_path):
    docs = [
        _report("1", "20200105", [("Aspirin", "NSAID [EPC]", "1"), ("Statinol", "Statin [EPC]", "2")], ["Nausea", "NAUSEA"], seriousnessdeath="1"),
        _report("2", "2020", [("Statinol", "Statin [EPC]", "1")], ["Rash"]),
        _report("3", "20200301", [], ["Rash"]),
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)))
    raw = reports.read_reports(spark, str(tmp_path / "r.json"))
    scan = {r["report_id"]: r for r in reports.report_scan(raw).collect()}
    assert scan["1"]["n_drugs"] == 2 and scan["1"]["deaths"] and scan["2"]["receipt_date"] is None and scan["3"]["n_drugs"] == 0
    every = {r["report_id"]: r for r in reports.class_baskets(raw).collect()}
    assert sorted(every["1"]["drugs"]) == ["NSAID [EPC]", "Statin [EPC]"] and every["1"]["reactions"] == ["NAUSEA"]
    assert every["1"]["indications"] == ["Pain"] and every["3"]["drugs"] == []
    suspect = {r["report_id"]: r["drugs"] for r in reports.class_baskets(raw, [reports.SUSPECT]).collect()}
    assert suspect["1"] == ["NSAID [EPC]"]
    assert B.eligible(reports.class_baskets(raw)).count() == 2
    assert reports.report_drug(raw).where("haystack like '%statinol%'").count() == 2
    assert reports.report_reaction(raw).distinct().count() == 3
    assert scoring.score(reports.class_baskets(raw)).count() == 3


def test_possessives_are_one_reaction(spark, tmp_path):
    spelt = ["Fournier^s gangrene", "FOURNIER'S GANGRENE", " fournier\u2019s gangrene "]
    docs = [_report(str(i), "20200105", [("Aspirin", "NSAID", "1")], [t, t.upper()]) for i, t in enumerate(spelt)] + [_report("9", "20200105", [("Statinol", "Statin", "1")], ["Rash"])]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)))
    baskets = reports.class_baskets(reports.read_reports(spark, str(tmp_path / "r.json")))
    assert {tuple(r["reactions"]) for r in baskets.collect()} == {("FOURNIER^S GANGRENE",), ("RASH",)}
    for asked in spelt:
        assert [r["a"] for r in scoring.score(baskets, reaction_filter=asked).collect()] == [3]
        assert [(r["a"], r["reaction_pt"]) for r in scoring.score_one(baskets, "NSAID", asked).collect()] == [(3, "FOURNIER^S GANGRENE")]
    (tmp_path / "stop.txt").write_text("\n".join(spelt))
    assert [r[0] for r in files.term_list(spark, str(tmp_path / "stop.txt")).collect()] == ["FOURNIER^S GANGRENE"]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# note\ndrug ineffective\n\n Extra Dose \n")
    assert sorted(r[0] for r in files.term_list(spark, str(tmp_path / "stop.txt")).collect()) == ["DRUG INEFFECTIVE", "EXTRA DOSE"]
    config = {
        "_note": "x", "areas": {"lipid": {"label": "l", "classes": ["A [EPC]", "B [EPC]"]}},
        "classes": {"statin": {"pharm_class_epc": "A [EPC]", "area": "lipid", "molecules": {"atorvastatin": ["atorvastatin", "Lipitor"]}}},
    }
    (tmp_path / "t.json").write_text(json.dumps(config, indent=1))
    doc = files.targets(spark, str(tmp_path / "t.json"))
    cat = files.catalogue(doc)
    assert {(r["alias"], r["drug"]) for r in lookup.alias_dim(cat).collect()} == {("statin", "statin"), ("atorvastatin", "atorvastatin"), ("lipitor", "atorvastatin")}
    assert files.area_members(doc).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"_note": "text", "A [EPC]": ["statins", "HMG"]}))
    assert [(r["epc"], r["phrases"]) for r in files.synonyms(spark, str(tmp_path / "s.json")).collect()] == [("A [EPC]", ["statins", "HMG"])]


def test_bulk_files_to_facts(spark, tmp_path):
    def dump(name, rows):
        (tmp_path / name).write_text(json.dumps({"meta": {}, "results": rows}))
        return str(tmp_path / name)

    sub = lambda t, s, d: {"submission_type": t, "submission_status": s, "submission_status_date": d}
    apps = dump("a.json", [
        {"application_number": "N1", "products": [{"brand_name": "Widgetol", "active_ingredients": [{"name": "WIDGET HCL"}]}], "submissions": [sub("SUPPL", "AP", "19800101"), sub("ORIG", "AP", "19990203")]},
        {"application_number": "N2", "products": [{"brand_name": "X", "active_ingredients": [{"name": "widget"}]}], "submissions": [sub("ORIG", "TA", "19700101")]},
    ])
    ndc = dump("n.json", [{"product_ndc": "1", "generic_name": "Anvil", "brand_name": "B", "active_ingredients": []}])
    rec = dump("r.json", [
        {"recall_number": "R1", "status": "Ongoing", "product_description": "widget tablets", "classification": "Class I", "recall_initiation_date": "20200101"},
        {"recall_number": "R2", "status": "Terminated", "product_description": "widget", "classification": "Class I", "recall_initiation_date": "20210101"},
    ])
    sho = dump("s.json", [
        {"status": "To Be Discontinued", "generic_name": "Anvil", "initial_posting_date": "1"}, {"status": "Current", "generic_name": "Anvil", "initial_posting_date": "2"},
        {"status": "Current", "generic_name": "Anvil", "initial_posting_date": "3"},
    ])
    molecules = spark.createDataFrame([("widget", ["widget"]), ("anvil", None), ("rod", ["rod"])], "molecule string, variants array<string>")
    members = spark.createDataFrame([("tools", "widget"), ("tools", "anvil")], "class string, molecule string")
    facts = X.drug_facts(
        molecules, members, files.application_records(files.bulk(spark, apps, files.APPLICATION)), files.directory_records(files.bulk(spark, ndc, files.DIRECTORY)),
        files.recall_records(files.bulk(spark, rec, files.RECALL)), files.shortage_records(files.bulk(spark, sho, files.SHORTAGE)), "2024-01-31",
    )
    got = {r["drug"]: r for r in facts.collect()}
    assert str(got["widget"]["first_approval"]) == "1999-02-03" and got["widget"]["applications"] == 1 and got["widget"]["years_marketed"] == 25.0
    assert not got["widget"]["marketed_now"] and got["anvil"]["marketed_now"] and got["rod"]["first_approval"] is None
    assert (got["widget"]["recalls_open"], got["widget"]["recalls_class_i"], got["widget"]["recall_latest"]) == (1, 1, "20200101")
    assert (got["anvil"]["shortage_status"], got["anvil"]["shortage_since"]) == ("Current", "2")
    assert got["tools"]["from_class_members"] and str(got["tools"]["first_approval"]) == "1999-02-03"


def test_publish_reads_back(spark):
    df = spark.range(10).selectExpr("concat('d', id % 3) as drug", "concat('r', id) as reaction_pt", "cast(id as double) as IC025")
    back = sinks.publish_scored(df)
    assert back.count() == 10 and back.inputFiles()[0] not in df.inputFiles()
