"""Training files of any layout are read by two scans a format."""

import json

from talentgrid.sources import readers as R


def _rows(df):
    return sorted(((r.source.rsplit("/", 1)[1], r.text, r.category, r.skills) for r in df.collect()), key=str)


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    files = {
        "resume_data.csv": 'id,Resume_str,Category\n1,"two\nlines, ""quoted""",007\n2,plain,1.50\n',
        "wide.csv": '\n"Job_Title",a,b,c,"The ""Text""",Key Skills\nchef,1,2,3,cook wanted,"x, y"\nshort\n',
        "nothing_known.csv": "first,second\nalpha,beta\n",
        "job_descriptions.csv": "text,job_description,category,skills_required\nno,yes,IT,SAP\n",
        "header_only.csv": "text,category\n",
        "empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert _rows(R.read_training_sources(spark, [str(tmp_path / n) for n in files])) == sorted([
        ("resume_data.csv", 'two\nlines, "quoted"', "007", None), ("resume_data.csv", "plain", "1.50", None),
        ("wide.csv", "cook wanted", "chef", "x, y"), ("wide.csv", None, "short", None),
        ("nothing_known.csv", "alpha", None, None), ("job_descriptions.csv", "yes", "IT", "SAP")], key=str)


def test_json_objects_and_arrays(spark, tmp_path):
    files = {
        "many.json": json.dumps([{"Description": "one", "role": "R", "skills": ["a", "b"]}, {"zip": 1}, {"Description": None}]),
        "single.json": json.dumps({"text": "two", "n": 1.5}),
        "broken.json": '{"text": ',
        "none.json": "[]",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert _rows(R.read_training_sources(spark, [str(tmp_path / n) for n in files])) == sorted([("many.json", "one", "R", "a, b"), ("many.json", None, None, None), ("many.json", None, None, None),
                          ("single.json", "two", None, None)], key=str)


def test_no_more_plan_for_more_files(spark, tmp_path):
    paths = []
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(f"{'x,' * (i % 4)}text\n{'1,' * (i % 4)}t{i}\n", encoding="utf-8")
        paths.append(str(tmp_path / f"f{i}.csv"))
    df = R.read_training_sources(spark, paths)
    assert sorted(r.text for r in df.collect()) == sorted(f"t{i}" for i in range(30))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") <= 2
    assert R.read_training_sources(spark, []).count() == 0
