"""Fixed values of the domain: place names, vocabularies and identities that results depend on."""

# Districts, in their usual order; names without the suffix get it.
DISTRICT_SUFFIX = "区"
SHORT_DISTRICTS = ("滨江", "拱墅", "西湖", "上城", "萧山", "余杭", "临平", "钱塘")
MAIN_DISTRICTS = ("滨江区", "拱墅区", "西湖区", "上城区")
CORE_DISTRICTS = ("滨江区", "拱墅区", "西湖区", "上城区", "钱塘区")
CITY_PREFIX = "杭州市?"
SCHOOL_PREFIX = "(浙江省)?杭州市?"

# Catalogue coverage (degrees), radii (metres), limits.
COVERAGE = (118.9, 29.5, 121.0, 31.0)
EARTH_RADIUS_M = 6371000
CAMPUS_RADIUS_M = 180
NEARBY_RADIUS_M = 2000
NEARBY_BOX = (0.023, 0.019)
FRESH_DAYS = 30
SOURCE_PAGE = 40
POST_LIMIT = 5000
SHARDS = 128
MIN_MEANINGFUL = 40
MIN_MENTION = 3
MIN_SNAPSHOT_ROWS = 100
MIN_TREND_POINTS = 8
DISTRICT_FALLBACK = 8
RANK_LABELS = 20
UNRANKED = 9999
NAME_COLLATION = "zh"

# The public listing site whose project identifiers are kept, and the conflicting one.
PROJECT_HOST = "m.fang.com"
PROJECT_PATH = "/chengjiao/hz/"
PROJECT_PARAM = "projcode"
PROJECT_NAMESPACE = "fang"
CONFLICTING_PROJECT = "2011155836"

# Relation kinds.
AFFILIATION = "documented_campus_affiliation"
PORTAL_MATCH = "portal_coordinate_match"
LOCAL_ARCHIVE = "local_policy_archive"

# Words that decide whether a home is named, and whether a post is about rent only.
GENERIC_HOMES = ("安置房", "回迁房", "商品房", "学区房", "二手房", "新房", "保障房", "公租房", "廉租房", "住宅", "公寓", "别墅", "小区", "社区", "楼盘", "写字楼")
ROAD_OR_NUMBER = "(?:大道|公路|路|街|巷|弄)$|[0-9一二三四五六七八九十百]+(?:[-—之][0-9一二三四五六七八九十百]+)?号(?:楼|栋|幢)?$"
INVESTMENT = "投资出租|出租(?:流通性|回报率?|收益|难易|需求|周期)"
RENTAL = "租房|出租|整租|合租|转租|直租|月租|租期|已租|租出|短租|长租|招租|租赁|必租|押[一二三四五六七八九0-9]+付|租金[^\\n]*/月"
SALE = "出售|卖房|买房|购房|二手房|诚售|直售|急售|售房|销售价|挂牌价|成交价"
PURCHASE = "(?:买了|买下|买入|购入|入手|置换)[^，。！？\\n]{0,16}(?:学区房|房)"
PHASE = "(?:[一二三四五六七八九十百0-9]+期|[东西南北]区|[一二三四五六七八九十0-9]+组团|[0-9]+(?:幢|栋|号楼))"
ACTIVE_SALE = "^(?:待售|在售|预售|现房销售|尾盘)$"
NEW_PROJECT_NOTE = "(?:历史[／/]新房楼盘|历史楼盘[／/]新房页)口径"
UNIT_PRICES = ("元/㎡", "元/平方米")
