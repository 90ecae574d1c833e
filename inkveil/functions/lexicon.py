"""Word lists of the domain. Results must agree on every entry, in this order."""

LEGAL_SUFFIXES = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "幼儿园", "公司", "集团")
INSTITUTION_SUFFIXES = ("保险股份有限公司", "保险有限公司", "保险公司", "商业银行股份有限公司", "股份制商业银行", "农村商业银行", "商业银行", "银行", "人民法院", "人民检察院", "公安局", "税务局", "医院", "学校", "律师事务所", "会计师事务所")
INDUSTRY_TERMS = (
    "房地产开发", "饮料", "建筑工程", "建设工程", "电力建设", "电力工程", "园林绿化工程", "装饰工程", "设计", "新能源", "运输", "物流", "科技", "教育科技",
    "文化传媒", "物业管理", "人力资源服务", "燃气", "水务", "医药", "药业", "钢铁", "电子商务", "贸易", "商贸", "咨询", "服务",
)
PROVINCE_NAMES = (
    "北京", "天津", "河北", "山西", "内蒙古", "辽宁", "吉林", "黑龙江", "上海", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南",
    "湖北", "湖南", "广东", "广西", "海南", "重庆", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆",
)
COMMON_SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜谢范彭马苗方袁唐薛雷贺倪汤罗郝安常于傅康伍余顾孟黄萧尹姚邵汪毛董梁杜阮贾路江郭梅林钟徐邱骆高夏蔡田胡万卢莫曾白王"

#: Legal vocabulary, verbs and frequent misreadings that are no names. Fixed values.
NO_PERSON_WORDS = (
    "原告", "被告", "本院", "法院", "裁定", "判决", "公司",
    "合同", "项目", "工程", "事实", "法律",
    "规定", "根据", "认为", "审理", "查明", "适用", "依法",
    "上述", "如下", "另有", "对于", "关于", "有关", "由于",
    "鉴于", "依照", "按照", "予以", "不予",
    "共同", "各自", "应当", "可以", "不得", "已经", "尚未",
    "进行", "作出", "提出", "提交", "出具", "提供",
    "存在", "发生", "产生", "决定", "确认", "认定", "确定",
    "当事人", "委托", "法定", "代理", "诉讼", "起诉", "上诉", "申诉",
    "负责人", "代表人", "代理人", "辩护人", "权利人", "义务人",
    "人数", "两年内", "一年内", "补充", "说明", "本案", "他人", "本人",
    "三原告", "两原告", "三被告", "两被告", "原审", "被申请", "申请",
    "双方", "各方", "对方", "本方", "通知", "公告", "送达",
    "费用", "金额", "损失", "利息", "无效", "有效", "解除", "终止",
    "履行", "支付", "请求", "主张", "配合", "协助", "支持", "理由",
    "陈述", "辩称", "答辩", "陈述意见", "抗诉",
    "执行", "裁决", "判令", "承担", "案情", "起诉状", "答辩状", "委托书", "代理词",
    "单位", "毕业", "订立", "成立", "设立", "责任", "见过", "帮忙", "结算", "开庭",
    "开庭后", "劳动者", "代表", "表示", "工作", "任职", "离职", "入职", "集团", "中心", "都用",
    "部门", "块", "圈", "后", "没见", "见过章", "明确", "法庭",
    "包含", "施工", "法官", "齐齐", "利润", "时三方", "时到期", "时甲方", "时该条", "时还约",
    "水采暖", "水配管", "水管道", "水管清", "时期其", "应检测", "应实体", "安装费",
    "安置方", "所说", "正义", "仲裁", "应以",
    "通过", "经由", "经营", "劳动", "劳力", "劳务", "安装", "万元", "平房", "房屋",
    "应予", "应债", "应就", "应票", "应该", "应项", "应造价", "应商票", "应向",
    "方式", "方法", "方上", "程序", "管理", "质证", "都属", "甄别", "明显",
    "公共", "公平", "公序", "公交", "司法", "制度", "维持", "驳回", "扰乱",
    "国家", "范围", "反映", "步推", "保护", "限制", "组织", "全面",
    "高水", "花架", "解协",
    "同意", "不同意", "第一", "第二", "第三", "仲裁委", "仲裁时",
    "包括", "作为", "案涉", "权限",
    "甲方", "签约", "维护", "而非", "银行流水", "人员混同", "仍然认可", "同时",
    "将水搅浑", "无关", "无权再向", "欲证实", "直至今日", "老贾", "目标松地",
)
PERSON_PARTICLES = ("的", "了", "在", "是", "去", "给", "有", "我", "你", "他", "们", "这", "那", "个", "对", "后", "做", "用")
PERSON_TAIL_ACTIONS = "全均承提抗扣图聊反送担到打替找查验收据向属力监者称证过进内无赔手交破期满合范工费还详适关就形备规约债票项款应出拨支负签协公"
PERSON_SHORT_ENDS = ("提", "未", "内", "反", "聊", "分", "也", "吗", "呢", "吧", "啊", "呀")
PERSON_SHORT_STARTS = ("方", "施工", "法官", "齐齐", "包含")
PERSON_WORKS = ("采暖", "配管", "管道", "管清", "检测", "实体", "安装费", "时期", "施工", "进度", "过程中", "过错", "费用")

ORG_SENTENCE_WORDS = ("合同", "证据", "佐证", "在卷", "协议", "诉讼", "裁判", "本案", "案涉", "原告", "被告", "第三人", "本院", "转账", "凭证", "案卷")
ORG_ACTION_VERBS = (
    "违反", "拒绝", "接受", "返还", "邮寄", "接管", "工作", "往返", "报销", "成立", "设立", "注销", "变更", "起诉", "上诉", "答辩", "申诉", "执行", "查封", "扣押", "冻结", "辞退", "解雇", "开除", "离职", "入职",
    "购买", "销售", "生产", "加工", "制造", "维修", "安装", "运输", "承包", "租赁", "出租", "派遣", "支付", "履行", "不服", "认为", "陈述", "进行", "支持", "协助", "配合", "加盖", "盖章", "签章", "签字",
    "损害", "不接受", "交跟", "去跟", "发放", "归属", "使用", "核对", "核实", "审查", "交给", "转给", "遵循", "通知", "依据", "根据", "汇入", "聘用",
)
INDUSTRY_CORE_SUFFIXES = ("运输", "建设", "工程", "制造", "销售", "租赁", "装饰", "物流", "物业", "开发", "投资", "科技", "信息", "服务", "咨询", "代理", "管理", "贸易", "商贸", "建筑", "劳务", "环保", "能源", "置业", "产业", "电力", "水利")
NO_BRANDS = (
    "家具", "家居", "设备", "材料", "建材", "食品", "服装", "药品", "商品", "货物", "物品", "物资", "器材", "器械", "用品", "产品", "配件", "零件", "购买", "销售", "生产", "加工", "制造", "维修", "安装", "运输",
    "管理", "经营", "服务", "咨询", "代理", "承包", "租赁", "出租", "策划", "有限", "责任", "股份", "集团", "开发", "建设", "检测", "检验", "造价", "质检",
)
NO_ORG_CORES = (
    "工程", "建筑劳务", "建设", "房地产", "房地产开发", "技术", "科技", "燃气", "药业", "生态环境", "独资", "留存", "完善", "扩大适用", "检测技术", "检测技术服务", "工程质检技术", "建筑材料设备检验", "工程造价", "建工技术", "电子", "声旺",
    "建筑安装", "建筑科技", "建设工程", "水电开发", "企业发展", "流域水电", "网络技术", "信息技术", "策划",
)
ORG_PRONOUNS = ("我", "你", "他", "本", "该", "贵", "此", "两", "两家", "各", "各家", "某", "一", "两个", "几家", "见两个")
ORG_CORE_PRONOUNS = (
    "我", "你", "他", "本", "该", "贵", "此", "来我", "我去", "我区", "你区", "来",
    "中国", "中华", "全国", "地方", "本地", "其实", "确实", "事实", "真实", "证实",
    "落实", "实", "但是", "可是", "若是", "总是", "但", "并", "且", "及", "或", "已",
    "曾", "即", "就", "也", "都", "而", "上", "下", "前", "后", "两", "两家", "三",
    "三家", "双", "各", "各家", "某", "某家", "一", "用", "指", "往", "去", "分",
    "联", "劳动者", "单位", "两个", "二公司", "三公司", "多个", "几家", "见两个",
    "两个公司", "三家公司", "外两家", "达等", "任何", "刺破", "代", "备选机构",
    "机构", "股东用", "非", "说", "知", "解", "知天煜",
)
#: Endings by which an organization's own name is told from what was taken along; the longest that fits counts.
ORG_ENDINGS = (
    "有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "律师事务所", "会计师事务所", "公司", "集团", "经营部", "安装部", "安装队", "经销处", "商行", "工作室",
    "委员会", "管理局", "公安局", "税务局", "中心", "医院", "学校", "幼儿园", "银行", "个体工商户", "厂", "店",
)
ORG_SURFACES = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "律师事务所", "会计师事务所", "公司", "集团", "银行", "分行", "支行")
PARTY_ROLES = ("申诉人", "被申诉人", r"原告(?:\d+)?", r"被告(?:\d+)?", "第三人", "申请人", "被申请人", "上诉人", "被上诉人", "再审申请人", "再审被申请人", "原审原告", "原审被告")
NAME_JOINTS = ("和", "及", "与", "、", "，", ",", "；", ";", "原名", "曾用名为", "曾用名", "原名称", "简称为", "简称", "以下简称", "下称")
PERSON_TAILS = "及辩诉称和与等已在于男女将被原吗呢吧啊呀"

PLACE_REFERENCES = ("案涉", "周边", "目前", "本案", "该案", "上述", "涉案", "本市", "本省", "本区", "本县", "本村")
PLACE_NO_CORES = ("周边", "案涉", "目前", "案涉小", "案涉小区", "周边小区", "本案", "该案", "上述", "涉案")
PLACE_BEFORE = "所辖各县全将及涉除等本该此上前后下含包由自因从对为与和或到至向在"
PLACE_NO_CHARS = "做不是有的了吗呢把被让给跟关得过着会能要想可就也还都很太更最只但而且因所以如果虽然却并没无非即使已经正常并且或者在由向对从至到为与和或含包自购买使用需求满足达超低高属于价格数量导致办请找等候住未无非没扰乱维驳映范围限制护境息商务总金融反组织全面制度规"
PLACE_GENERIC = (
    "省", "市", "区", "县", "镇", "乡", "村", "街道", "社区", "自治区", "自治州",
    "市甲", "省丙", "其他村", "我村村", "城中村", "安置区", "生活区",
    "年郊区", "年郊", "玉村村",
    "大部分地区", "建设村", "政府农村", "政府报县", "接单区", "逐级报乡",
)
PLACE_NO_STARTS = (
    "主方", "之后", "乎", "事处", "人石家庄", "代大马", "件规定及", "公司及",
    "三个", "扰乱", "范围内", "国家", "维持", "驳回", "反映一定地",
    "息地生境", "金融总部", "商务", "城一层国医馆", "年郊",
    "利人", "县长岗", "司将", "告", "址湖北", "垫付", "天记录", "委托前往",
    "威华泰", "审斜角头", "家庄", "局同意", "年张岩海上", "年长岗",
    "府各部门", "建二局同意", "建石家庄", "开始出资协助", "待长岗",
    "挥部进驻", "揽石家庄", "日井陉", "日石家庄", "时城中", "曾志学表示",
    "月一年期", "月内进驻", "服石家庄", "照石家庄", "理石家庄",
    "甲方长岗", "祥子送往", "系邢台", "联合开发", "起确认", "订石家庄",
    "销石家庄",
)
PLACE_NO_WORDS = (
    "产权", "进行", "项目", "工程", "施工", "合同", "协议", "纠纷", "案件",
    "单位", "劳动者", "原告", "被告", "第三人", "本院", "回迁", "拆迁",
    "撤销", "设立", "注销", "地址", "地点", "位置",
    "农业农村", "贷款", "法律主体", "女儿墙", "党支部", "负责人称",
    "享受", "规定", "同意", "部门", "调差", "砌体", "票权利人",
    "逐级报", "遵循", "负责", "本地建筑", "农村村", "分分区",
    "技术产业", "集团", "融创", "宅基地", "省道",
    "地块", "地上", "停工前", "应按照", "故西", "重新确认",
    "扰乱", "范围内", "国家", "维持", "驳回", "反映", "息地",
    "保护", "金融", "总部", "商务", "制度", "全面", "组织",
    "限制", "一定地", "国医馆", "年郊",
)
#: What may stand before a place without being part of it.
PLACE_LEADS = ("涉及所辖", "涉及", "所辖", "各县", "除特殊企业及", "除", "各", "全", "将", "及", "涉", "等", "本", "该", "此", "上", "前", "后", "下")

#: Cities that companies are called after, without their suffix; the longest first.
CITY_NAMES = (
    "呼和浩特", "乌鲁木齐", "石家庄", "哈尔滨", "内蒙古", "北京", "上海", "天津", "重庆", "太原", "沈阳", "长春", "南京", "杭州", "合肥", "福州", "南昌", "济南", "郑州", "武汉", "长沙",
    "广州", "南宁", "海口", "成都", "贵阳", "昆明", "拉萨", "西安", "兰州", "西宁", "银川", "大连", "青岛", "宁波", "厦门", "深圳", "苏州", "无锡", "佛山", "东莞", "珠海", "中山", "惠州",
    "温州", "绍兴", "嘉兴", "徐州", "南通", "常州", "烟台", "潍坊", "洛阳", "唐山", "邯郸", "保定", "广西", "西藏", "宁夏", "新疆", "延边",
)
INDUSTRY_STARTS = ("建设", "建筑", "装饰", "安装", "工程", "电力", "新能源")
OUTLETS = ("经营部", "安装部", "安装队", "经销处", "合作社", "商行", "工作室", "厂", "店")
#: Shapes of an organization's whole name, and words that tie two names to one company.
ORGANIZATION = (
    r"(?:^|(?<=[\s，,。；;：:、（(与和及由向对给找]))[一-龥A-Za-z0-9（）()·]{2,45}?"
    r"(?:有限责任公司|股份有限公司|集团有限公司|有限公司|律师事务所|会计师事务所|保险公司|商业银行|幼儿园|公司|集团|银行)"
    r"(?:[一-龥A-Za-z0-9·]{1,20}(?:分行|支行|分公司|营业部))?"
    r"|(?:^|(?<=[\s，,。；;：:、（(与和及由向对给找]))[一-龥A-Za-z0-9（）()·]{4,45}(?:医院|学校|人民法院|人民检察院|公安局|税务局)"
)
SAME_COMPANY = "后更名为|更名为|变更为|改名为|原名称|原名|曾用名|原公司名称|原为|原系|现名称|现名|以下简称|简称为|简称|下称"
