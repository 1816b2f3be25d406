"""Parsed answers and rewards on dirty fixtures; every rollout of the task must have its row."""

from cinderloom.plans import rewards as R


def test_choice_letters(spark):
    cases = [
        ("llava_mcq", "B", " b ", "B", "B", 0, 1), ("llava_mcq", "C. Roast the beans", "C", "C", "C", 0, 1),
        ("llava_mcq", "<answer>A</answer> no, <ANSWER>\n(D) x y D.</ANSWER>", "D", "D", "A", 1, 1),
        ("llava_mcq", "<answer>Der Mechaniker</answer>", "D", None, None, 1, 0), ("llava_mcq", "<answer>none</answer> so E", "E", "E", "E", 1, 1),
        ("event_logic_fill_blank", "The answer is c, not a", "C", "A", "C", 0, 0), ("event_logic_predict_next", "<answer>F</answer>", "F", "F", "F", 1, 1),
        ("seg_aot_event_dir_binary", "<answer>A</answer>", None, "A", "A", 1, 0), ("seg_aot_event_dir_binary", None, "A", None, None, 0, 0),
        ("llava_mcq", "选B", "B", None, None, 0, 0), ("event_logic_sort", "B", "B"), (None, "B", "B"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "row_id long, problem_type string, response string, ground_truth string")
    got = {r.row_id: tuple(r)[2:] for r in R.choice_letters(df).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases) if len(c) > 3}


def test_grounding_scores(spark):
    truth = "The event happens in the 10.0 - 20.0 seconds."
    cases = [
        ("10 - 20 seconds", truth, 1.0), ("<answer>15.0 to 20</answer>", truth, 0.5), ("<events>[[10, 15.0],[1,2]]</events>", truth, 0.5), ("from 10 and 20", truth, 1.0),
        (None, truth, 0.0), ("I can't tell", truth, 0.0), ("20 - 10 seconds", truth, 0.0), ("20 - 10 seconds, or 10 to 20", truth, 1.0), ("10 - 20 seconds", None, 0.0), ("10 - 20 seconds", "n/a", 0.0),
        ("<answer>10 to 20</answer><answer>10 to 20</answer>", truth, 0.0), ("[10-20] 10 - 20 seconds", truth, 0.0), ("30 - 40 seconds", truth, 0.0), ("10 - 20 seconds", "<events>[[10, 20]]</events>", 1.0),
        ("The event 'a 1 - 2 seconds\nb' happens in the 10 - 20 seconds", truth, 1.0),
    ]
    rows = [(i, "temporal_grounding", None, r, g) for i, (r, g, _) in enumerate(cases)] + [(90, "temporal_grounding", "k", "10 - 15 seconds", truth), (91, "ocr", "k", "1 - 2 seconds", truth)]
    df = spark.createDataFrame(rows, "row_id long, problem_type string, problem_id string, response string, ground_truth string")
    got = {r.row_id: r.reward for r in R.grounding_scores(df, spark.createDataFrame([("k", 20.0)], "problem_id string, duration double")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)} | {90: 0.375}


def test_sort_scores(spark):
    cases = [
        ("<answer>1 3, 2</answer>", "132", 1.0, 3), ("<answer>321</answer>", "123", 0.0, 1), ("<answer>2134</answer>", "1234", 0.75, 2), ("<answer>12</answer>", "1234", 1.0, 4), ("<answer>12345</answer>", "1234", 1.0, 4),
        ("<answer>9234</answer>", "1234", 0.625, 3), ("<answer>1</answer>", "12", 0.0, 0), ("132", "132", 0.0, 0), (None, "132", 0.0, 0), ("<answer>12</answer>", " ", 0.0, 0), ("<answer>21</answer> <ANSWER>12</ANSWER>", "12", 1.0, 2),
        ("<answer>0123456789</answer>", "0123456789", 1.0, 10), ("<answer>1234</answer>", "1213", 0.25, 2),
    ]
    df = spark.createDataFrame([(i, "event_logic_sort", c[0], c[1]) for i, c in enumerate(cases)], "row_id long, problem_type string, response string, ground_truth string")
    got = {r.row_id: (r.reward, r.n_right) for r in R.sort_scores(df).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
