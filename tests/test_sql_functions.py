from datetime import datetime

from pyspark.sql import functions as F
from waymark.functions import paths, sql
from waymark.sitemap import records


def test_functions_agree_with_the_columns(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    texts = ["/", "/*", "/*$", "/a$b", "/$$", "/a b", "é", 'a"<>', "", None, "/q!_%x*", "https://h.example/é?x#y", " Daily ", "never", "0.6", " 0.6", "1.5", "NaN", "1e-1"]
    df = spark.createDataFrame([(t, datetime(2022, 9, 12, 12)) for t in texts], "t string, d timestamp")
    t, d = F.col("t"), F.col("d")
    pairs = {
        "url_path(t)": paths.url_path(t), "normalize_path(t)": paths.normalize_path(t), "pattern_kind(t)": paths.pattern_kind(t), "like_pattern(t)": paths.like_pattern(t), "change_frequency(t)": records.frequency(t),
        "next_due(change_frequency(t), d)": records.next_date(records.frequency(t), d), "is_outdated(change_frequency(t), d, d)": records.is_outdated(records.frequency(t), d, d), "sitemap_priority(t)": records.parsed_priority(t),
    }
    for text, column in pairs.items():
        assert df.where(~F.expr(text).eqNullSafe(column)).count() == 0, text
    assert spark.sql("select path_matches('/fish*.php', '/fishheads/catfish.php?p') as a, path_matches('/*.php$', '/windows.PHP') as b").first() == (True, False)
