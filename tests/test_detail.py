"""The nested detail of recipes: order, repetitions, what is not there, which observation counts."""

from graphloom.operators import detail


def test_nested_detail(spark):
    frame = spark.createDataFrame
    recipes = frame([("r", "Leek"), ("bare", None)], "id string, title string")
    link = lambda *x: (*x, *[None] * (7 - len(x)))
    links = frame(
        [link("r", "s2", "HAS_STEP"), link("r", "s1", "HAS_STEP"), link("r", "s1", "HAS_STEP"), link("r", "lost", "HAS_STEP"), link(None, "s1", "HAS_STEP"), link("other", "s9", "HAS_STEP")]
        + [link("r", "q", "HAS_SOURCE", "steps"), link("r", "q", "HAS_SOURCE", "goal"), link("r", "i", "HAS_INGREDIENT", None, "rule"), link("r", "m", "HAS_IMAGE"), link("r", "v", "HAS_VIDEO"), link("r", "m2", "HAS_IMAGE")]
        + [link("m", "s2", "ALIGNED_WITH", None, None, "new", 0.5), link("m", "s1", "ALIGNED_WITH", None, None, "old", 0.9), link("m", "s9", "ALIGNED_WITH", None, None, "new", 0.7)],
        "start_id string, end_id string, type string, role string, method string, run_id string, score double",
    )
    steps = frame([("s1", 1, "Cut", "q"), ("s2", 2, "Fry", "q"), ("s9", 1, "Else", "q")], "id string, order int, text string, source_id string")
    sources = frame([("q", "zip")], "id string, archive string")
    media = frame([("m", "image", "q", True, "local", "done"), ("v", "video", None, None, None, "not_run"), ("m2", "image", "q", False, "remote", None)], "id string, kind string, source_id string, downloaded boolean, storage string, recognition string")
    seen = frame([("o1", "m", "q", "old", "a"), ("o2", "m", "q", "new", "b"), ("o3", "m", "else", "newest", "c"), ("o4", "m", "q", "running", "d"), ("o5", "m2", "q", None, "e")], "id string, media_id string, source_id string, run_id string, caption string")
    runs = frame([("old", 1), ("new", 2), ("newest", 3), ("running", None)], "run_id string, finished_at int")
    tables = [links, steps, sources, frame([("i", "leek")], "id string, name string"), media, seen, runs]
    rows = {r.id: r for r in detail.recipe_detail(recipes, *tables).collect()}
    r, bare = rows["r"], rows["bare"]
    assert [(s.id, s.text) for s in r.steps] == [("s1", "Cut"), ("s2", "Fry")] and r.recipe.title == "Leek"
    assert [(s.role, s.id, s.archive) for s in r.sources] == [("goal", "q", "zip"), ("steps", "q", "zip")]
    assert [(x.name, x.method) for x in r.ingredient_mentions] == [("leek", "rule")]
    assert (r.media.images, r.media.videos, r.media.downloaded_images, r.media.downloaded_videos, r.media.recognition_not_run, r.media.storage_modes) == (2, 1, 1, 0, 1, ["local", "remote"])
    assert [(x.id, x.source and x.source.archive) for x in r.media.inventory] == [("m", "zip"), ("m2", "zip"), ("v", None)]
    assert [(x.media_id, x.observation_id, x.step_id, x.score) for x in r.visual_evidence] == [("m", "o2", "s2", 0.5), ("m2", "o5", None, None)]
    assert (bare.steps, bare.sources, bare.ingredient_mentions, bare.visual_evidence, bare.media.images, bare.media.inventory) == ([], [], [], [], 0, [])
    empty = [t.limit(0) for t in tables]
    assert [len(x.steps) for x in detail.recipe_detail(recipes, *empty).collect()] == [0, 0] and detail.recipe_detail(recipes.limit(0), *tables).count() == 0


def test_lines_are_dealt_few_times(spark, shuffled, folder):
    """Links are dealt by their ends and by recipe, not once more for each list; alignments of other runs are not dealt."""
    from graphloom.plans.catalogue import QUERIES

    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        dealt = shuffled(lambda: QUERIES["q_recipe_detail"](spark, "/root/testdata/sf0.01").write.parquet(f"{folder}/out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt < 250 * lines


def test_many_recipes_and_repeated_media(spark, monkeypatch):
    """The same rows whether tables go out whole or are dealt; a step of two recipes, one medium under two kinds of links."""
    frame = spark.createDataFrame
    recipes = frame([(f"r{i}",) for i in range(40)], "id string")
    link = lambda *x: (*x, *[None] * (7 - len(x)))
    made = [link(f"r{i}", f"s{(i + j) % 50}", "HAS_STEP") for i in range(45) for j in range(3)] + [link(f"r{i}", f"m{i % 7}", kind) for i in range(45) for kind in ("HAS_IMAGE", "HAS_VIDEO")]
    made += [link(f"m{i % 7}", f"s{i}", "ALIGNED_WITH", None, None, run, i / 64) for i in range(50) for run in ("a", "b") for _ in range(2)]
    links = frame(made, "start_id string, end_id string, type string, role string, method string, run_id string, score double")
    steps = frame([(f"s{i}", i % 3, "t", "q") for i in range(50)], "id string, order int, text string, source_id string")
    media = frame([(f"m{i}", "image" if i % 2 else "video", "q", True, "local", "done") for i in range(7)], "id string, kind string, source_id string, downloaded boolean, storage string, recognition string")
    seen = frame([(f"o{i}", f"m{i % 7}", "q" if i % 3 else "x", "a" if i % 2 else "b", "c") for i in range(30)], "id string, media_id string, source_id string, run_id string, caption string")
    tables = [links, steps, frame([("q", "zip")], "id string, archive string"), frame([("i", "leek")], "id string, name string"), media, seen, frame([("a", 1), ("b", 2)], "run_id string, finished_at int")]
    rows = sorted(detail.recipe_detail(recipes, *tables).collect())
    monkeypatch.setattr(detail, "FEW", 1)
    assert sorted(detail.recipe_detail(recipes, *tables).collect()) == rows and len(rows) == 40
    one = next(r for r in rows if r.id == "r1")
    assert [x.media_id for x in one.visual_evidence] == ["m1"] * len(one.visual_evidence) and {x.run_id for x in one.visual_evidence} == {"b"}
    assert [(x.step_id, x.score) for x in one.visual_evidence] == [(None, None)] or all(int(x.step_id[1:]) % 7 == 1 for x in one.visual_evidence)
