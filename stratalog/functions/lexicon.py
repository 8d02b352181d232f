"""Default word lists of the signal operators. Fixed values; every operator takes others as parameters."""

TRAP_CN = ("坑", "错", "不对", "注意", "但是", "其实", "不过", "然而", "越界", "溢出", "死循环", "超时", "段错误", "为什么", "别", "小心", "容易犯", "反例")
TRAP_EN = ("bug", "tle", "mle", "wa", "error", "fail", "overflow")
TECH_CN = ("递归", "递推", "状态", "转移", "边界", "复杂度", "空间", "时间", "数组", "指针", "背包", "贪心", "优化", "容量", "价值", "重量", "体积", "下标", "输入", "输出", "例题", "反例", "证明", "循环", "函数", "变量", "参数", "树", "图", "栈", "队列", "堆", "哈希", "排序", "二分", "分治", "剪枝", "记忆化", "滚动", "正序", "逆序", "倒序", "不变量")
TECH_EN = ("dp", "dfs", "bfs", "max", "min", "vector", "int", "void", "return", "if", "for", "while", "const", "auto", "struct", "class", "memo")
CODE_WORDS = ("int", "void", "vector", "for", "while", "if", "return", "dp", "dfs", "bfs", "max", "min", "memo", "f", "g")
CODE_MARKS = r"(?<![a-zA-Z_])[a-zA-Z_][\p{L}\p{N}_]*+(?U:\s*+)[(=\[<>]|->|\+\+|--|==|!=|<=|>=|;(?U:\s*)\z"
FORMULA_MARKS = r"[=+\-*/^]|dp\[|f\(|O\(|\\sum|\\le|\\ge|\\in"
NOISE = (
    "扣[1一]|点个赞|投个币|粉丝牌|关注主播|谢谢.*礼物|送出.*飞机|送的.*礼物|感谢.*送的",
    "声音没问题吧|录像还在|麦克风|卡了没|画面卡不卡|能听到吗|听得清吗",
    "我喝口水|有点感冒|头晕|吃个饭|嗓子疼|先去个洗手间|抽根烟|开个空调|状态不好",
    "换个编辑器|调下字体|开不开弹幕|看下评论区|看下群|私信我|走神了",
)
REPEATED = ("对吧", "就是", "然后", "那个", "怎么说", "听懂了吗", "也就是说", "好吧", "其实就是")
FILLERS = ("呃", "啊", "呢", "吧", "呀", "这个", "那个", "你看", "对吧")
#: Ordered: earlier replacements change what later ones see.
HOMOPHONES = (
    ("五二比侧", "512比特"), ("五二比特", "512比特"), ("五二", "512"), ("五爻", "512"), ("循环左一", "循环左移"), ("循环阻一", "循环左移"),
    ("沙溢", "sha1"), ("沙一", "sha1"), ("山一", "sha1"), ("沙万", "sha1"), ("沙外", "sha1"), ("imd5", "md5"), ("前程", "填充"), ("前冲", "填充"),
    ("签证", "填充"), ("比他", "比特"), ("埃尔", "l"), ("用户运算", "异或运算"), ("用公算", "异或运算"), ("优化", "异或"), ("一会", "异或"), ("运回", "异或"),
    ("一或", "异或"), ("抑或", "异或"), ("结带", "迭代"), ("接待", "迭代"), ("生殖问题", "生日问题"), ("欧派", "opad"), ("欧派的", "opad"), ("max值", "mac值"),
)
STOPWORDS = (
    "问题", "方法", "时间", "数据", "情况", "方式", "结果", "过程", "系统", "功能", "内容", "时候", "地方", "东西", "意思", "例子", "大家", "同学",
    "我们", "你们", "他们", "这个", "那个", "什么", "怎么", "可以", "需要", "应该", "必须", "可能", "也许", "真的", "确实", "其实", "因为", "所以",
    "但是", "不过", "然而", "the", "a", "an", "and", "or", "but", "if", "of", "in", "on", "at", "to", "for", "with", "by", "is", "are", "was", "were",
)
CONCEPT_TYPES = ("concept", "algorithm", "technique", "data-structure")
CHINESE_MANUAL = ("zh-hans", "zh-cn", "zh", "zh-hant", "zh-tw")
CHINESE_AUTO = ("ai-zh", "zh-auto")
