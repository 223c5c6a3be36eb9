from symbolake.operators import style as S


def test_all_files_vote(spark):
    rows = [("r", f"{i:04}.py", ":param x" if i < 400 else "Args:") for i in range(900)]
    d = spark.createDataFrame(rows, "repo string, file_path string, text string")
    assert S.docstring_style(d).first().asDict() == {"repo": "r", "google": 500, "numpy": 0, "rest": 400, "jsdoc": 0, "style": "Google"}
    assert S.docstring_style(d, 400).first().google == 0
