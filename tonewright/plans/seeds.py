"""Seed snippets put before documents, as the corpus itself triggers almost no rule. Every snippet is our own text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions.text import sql_text
from tonewright.sources.files import spread

SNIPPETS = [
    "今天天气不错，我们去河边走了走。",
    "首先，团队要赋能一线；其次，形成闭环。综上所述，此举具有重要意义。",
    "值得注意的是，这个方案推动了生态建设！此外，它展示了新的格局。",
    "In summary, this robust and seamless tool is a game-changer. Moreover, we leverage it daily.",
    "First, open the box. Second, read it. Third, close it. Finally, rest.",
    "一方面成本在降，另一方面质量在升。既便宜，又好用。",
    "不仅速度快，而且体验好。虽然难，但值得一试。",
    "On one hand it is cheap, on the other hand it breaks. It is not only fast but also small. Both cats and dogs came.",
    "Not only is it new.\nIt also says that it is also known widely. Not only A. B but also C works!",
    "总而言之，由此可见，不难看出。总的来说，还行。简而言之，可以。",
    "Overall we agree. Ultimately nobody cares. In the end it rained. To conclude it worked.",
    "该技术的应用使得流程更顺。这一举措有助于改进。在此基础上，从某种意义上说，成立。",
    "It is important to note that rain falls. On this basis, we go. In a sense, yes. This initiative helps all.",
    "与时俱进，开拓创新，不忘初心。",
    "在当今时代，随着科技的快速发展，在新形势下，改革势在必行。",
    "我们从而进一步大力积极有效地做出明显的、充分的、全方位的改变。",
    "底层逻辑要拉通，颗粒度要细，打一套组合拳，抓住痛点，构建壁垒，降本增效。",
    "总之就是这样。总之算了！",
    "我们需要先想清楚。然后动手。最后收尾！",
    "应该说这没错。应该说还行！",
    "\n高效赋能、全面协同、深度转型。\n苹果、梨子、桃子。\n",
    "\n创新升级、优化提升、高效稳定、降低简化。\n红的、绿的、蓝的、黄的。\n",
    "有人可能会说不行。诚然，毋庸置疑。Admittedly, some might say it could be argued.",
    "研究表明喝水有益。但这是否意味着越多越好？",
    "此外，还有一点。另外，不要忘记！后面没有了。",
    "It is considered to be good。It was found to work. It has been shown to be so。",
    "对流程进行了优化。对方案做出慎重选择！对数据进行过滤，再决定。",
    "该技术的实现很难。鉴于此，我们利用资源。遵照执行！",
    "系统高效、稳定、便宜、好用。fast 的、reliable 的、scalable 的系统！",
    "极为重要。非常好！ highly 推荐。quite 不错！",
    "换句话说，就是不行。in other words 也是！",
    "第一点是成本。第二项：时间！第三点说明。",
    "可用性 99.97%，数百万用户，billions of dollars。",
    "我们必须努力。大家应该支持！we must 前进。",
    "各种办法都有。诸多问题！若干条件。several 方案。",
    "The system 很稳。This 不行！Our team 加油。",
    "家人们谁懂啊，这玩意儿太上头了，emo 了，yyds！玩意儿。",
    "说白了，说实话，讲真，你懂的，动动嘴就行，活生生的例子。怎么说呢，菜谱火候。",
    "> 引用里的绝绝子不算\n`躺平` 也不算\n正文没有。",
    "我头皮发麻，后背一凉，整个人愣住了，当场破防。",
    "写得慢的，比写得快的更可靠。越是着急，越容易错。真正的高手，从来不是天生。说到底，是耐心。这件事是一场修行。",
    "老实说，不骗你，恕我直言。",
    "作为一名工程师，我建议先看日志。我见过太多失败。",
    "三件事要记。5 个坑别踩。第1点：准备。\nA 先看说明书\n",
    "这不是运气，而是方法。并非偶然而是必然。不是所有的猫都怕水，也不是所有的狗都会游。",
    "他说——你听——我想——她笑———对吧 — 好。",
    "他来了——就这一次。",
    "停顿—— ——再停顿。",
    "这药能根治猫癣，三天见效，不用去医院，比医生还准。猫狗都能用。",
    "医生都没看出来的感染，抹了有效。有效缓解症状。",
    "最好的选择！第一名是他，第一次来。100% 满意，唯一能解决的办法，唯一标识，必备。",
    "在当今快节奏的社会，让我们一起探索。情绪价值满满，值得深思。不只是掉毛，更是一种信号。我成长了很多。",
    "收获很多，比如学会了做饭。不只是累，不只是困，更是难过。",
    "神器！幸福感拉满，直接让效率翻倍。",
    "发布于 2024年5月6日，版本 v1.2.3，时间 12:30，共 1,000,000 条，3.5%，HTTP 接口，MacBook，16GB，5万。",
    "建议尽快就医，请及时检查。猫咪呕吐、腹泻，仅供参考。",
    "我家猫😀😀😀 #养猫 #日常 我拍了照啊吧呢嘛哈诶！我去买菜，我摸它。",
    "```python\nprint('赋能')\n```\n用 `git` 和 `make`，见 https://a.example/b/ 与 /usr/bin/ 。v1.0.2 的 P99 延迟 3 ms。\n- a\n- b\n1. c",
    "你好,世界!真的吗?是的...好( 括号 )吧;对:完. 版本1.2,数字 a,b 。。你 好 世 界 ！！",
    "零宽\u200b字\u200c符\ufeff，全角ＡＢＣ１２３，兼容\uf900。",
    "的的的的的的的的的的的的的的的的的的的的的的很多。",
    "<think>Let me analyze this draft.</think>\n正文在此。\n✓ 已检查\nLet me re-check the strict rules now.\n正文在此。",
    "全面赋能核心业务，打造数智化新生态，夯实底层基座，为核心业务提供战略支撑，助力业务价值最大化落地。",
    "API_KEY=abc123\n# 注释=1\nTOKEN=\"${HIDDEN}\"\n NAME = '甲' \nPLAIN=$OTHER\nEMPTY=",
    "所谓“底层逻辑”只是引用；生态/闭环/赋能 也是。|拉齐|颗粒度|\n拉齐颗粒度，会有进一步的提升。",
]


def snippet():
    """The snippet of a document's turn."""
    return F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.pmod("doc_id", F.lit(len(SNIPPETS))) + 1).cast("int"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, scene_no and text: the snippet of the id's turn, a line feed, the whole document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("own")))
    return docs.select("doc_id", F.concat(snippet(), F.lit("\n"), F.coalesce("own", F.lit(""))).alias("text"))


SEEDED_SQL = f"seeded AS (SELECT doc_id, ([{', '.join(map(sql_text, SNIPPETS))}])[(doc_id % {len(SNIPPETS)}) + 1] || chr(10) || coalesce(text, '') AS text FROM documents)"

#: Turns of a snippet that make a text long enough for delivery.
TURNS = 14


def seeded_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: the snippet many times over for every other document, else as `seeded`."""
    docs = seeded(spark, sf_dir)
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.repeat(snippet(), TURNS)).otherwise(F.col("text")).alias("text"))


def seeded_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: for every third document the snippet alone with white space around it, else as `seeded`."""
    docs = seeded(spark, sf_dir)
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" \n"), snippet(), F.lit("\n\t "))).otherwise(F.col("text")).alias("text"))


_SNIPPET_SQL = f"([{', '.join(map(sql_text, SNIPPETS))}])[(doc_id % {len(SNIPPETS)}) + 1]"
LONG_SQL = f"{SEEDED_SQL}, long AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat({_SNIPPET_SQL}, {TURNS}) ELSE text END AS text FROM seeded)"
ALONE_SQL = f"{SEEDED_SQL}, alone AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) || {_SNIPPET_SQL} || chr(10) || chr(9) || ' ' ELSE text END AS text FROM seeded)"

#: Acceptance sets, of our own sentences: each adversarial one has to be found, each plain one left alone.
ADVERSARIAL = [
    "越是着急，越容易把事情做坏。", "不只是累，不只是困，更是难过。", "三件事要记住，少一件都不行。", "这不是运气，而是日复一日的方法。", "他说—你听—我想—她笑。", "这药能根治猫癣，三天见效。",
    "猫咪这样就不用去医院了。", "这是唯一能用的办法。", "情绪价值满满，值得深思。", "我头皮发麻，后背一凉。", "真是神器，幸福感拉满。", "老实说，不骗你，我也没想到。", "这一年我成长了很多。",
]
PLAIN = [
    "今天天气不错，我们去河边走了走。", "药膏一天抹两次，抹了快一个月。", "它闻了半天才进去，又出来了。", "楼下的面馆换了老板，味道淡了。", "我把照片洗出来，贴在冰箱上。", "公交晚点二十分钟，我走回去的。",
    "孩子睡了，我在阳台收衣服。", "窗台上的薄荷又长高了一截。", "他借走的书还没还。", "雨停了，路上全是水。",
]
ACCEPTANCE = [(-1 - i, t) for i, t in enumerate(ADVERSARIAL)] + [(-101 - i, t) for i, t in enumerate(PLAIN)]


def with_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: the acceptance sets under negative ids, and the seeded documents."""
    return seeded(spark, sf_dir).unionByName(spark.createDataFrame(ACCEPTANCE, "doc_id long, text string"))


ACCEPTANCE_SQL = f"{SEEDED_SQL[:-1]} UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {sql_text(t)})' for i, t in ACCEPTANCE)}) v(doc_id, text))"

#: Openings with and without their closings, for rewriting that keeps a part of each match.
SPAN_SNIPPETS = [
    "这不是运气，而是方法。并非偶然, 而是必然！不是猫而是狗。不是这样，也不是那样。",
    "It is not luck, but work. It was not just fast but small. It is not only fast but also small. Not a word.",
    "一方面便宜，更重要的是耐用。不仅快，更重要的是 稳！不仅如此。",
    "It is not only cheap, but more importantly it lasts. Not just now, but more importantly later!",
    "既便宜，又好用。不仅快，而且也稳。不但新，也好看，还轻！既然来了。",
    "It is not only fast but also small. Both red paint and blue paint came. Both left.",
    "一方面成本在降，另一方面质量在升。虽然难，但值得。虽然但是。不仅累而且困。",
    "On one hand, it is cheap, on the other hand, it breaks. Both cats and dogs. Not only A but also B.",
    "Not only is it new.\nIt is seen but also known widely. Not only is it old. It also works!",
    "首行 \n 次行\n\n\n 新段 \t\n \n再段\n",
    "，，好的。。的、行，！ 是 。系统性的，、全面的做法……",
    "甲。 ，乙！丙? 版本 v1.2 好. Then go.Now stop. 见 e.g.x 。",
    "`a` 与 https://a.b/c 间，“引文”外；甲/乙/丙。\n| 表 | 行 |\n尾。",
]


def seeded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: a snippet of openings and closings, a line feed, the whole document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("own")))
    turn = F.get(F.array(*map(F.lit, SPAN_SNIPPETS)), F.pmod("doc_id", F.lit(len(SPAN_SNIPPETS))).cast("int"))
    return docs.select("doc_id", F.concat(turn, F.lit("\n"), F.coalesce("own", F.lit(""))).alias("text"))


SPANS_SQL = f"spans AS (SELECT doc_id, ([{', '.join(map(sql_text, SPAN_SNIPPETS))}])[(doc_id % {len(SPAN_SNIPPETS)}) + 1] || chr(10) || coalesce(text, '') AS text FROM documents)"
