"""Fixed term lists of the domain.

Every list below is a table of fixed values: results depend on exactly these
terms.  One term per line, in the order in which ties are resolved.  Operators
never read these names directly; they take a :class:`Lexicons` so that a caller
can replace any list.
"""

from __future__ import annotations

from dataclasses import dataclass


def _terms(block: str) -> tuple[str, ...]:
    return tuple(line for line in block.split("\n") if line)


# --- fixed values -----------------------------------------------------------

REJECT_PATH_PARTS = _terms("""
/tag/
/tags/
/category/
/categories/
/company/
/market
/forum/
/user/
/users/
/projects/details/
/components/
/contest
/products/
/download/
/downloads/
/soft/
/page/
/search/
/author/
/baike/
/d/user/
/video/
/yuanqijian/
/dianlutu/
/resource/
/ace/
/home/
/forum
""")

REJECT_PATH_SUBSTRINGS = _terms("""
/article_
""")

REJECT_TITLES = _terms("""
404 页面不存在
page not found
301 moved permanently
object moved
提示信息
信息提示
subscription corner
archives |
composite archives
electronics news |
无标题
 redirecting to 
""")

BOILERPLATE_LINE_MARKERS = _terms("""
网站导航
登录 | 注册
欢迎来电子发烧友网
请输入元器件型号
编辑推荐
热门推荐
相关推荐
相关阅读
上一篇
下一篇
copyright
privacy policy
cookie policy
sign in
log in
join
please ensure that javascript is enabled
download files
add new maker
""")

SECTION_STOP_MARKERS = _terms("""
相关技术文章
相关资料下载
相关阅读
上周热点文章排行榜
上周资料下载排行榜
热门文章
热门下载
热门推荐
热门博文
热门社区
论坛热帖
用户评论
发表评论
深度阅读
电子资料下载
相关下载
阅读排行
热门词
创新实用技术专题
""")

EN_SECTION_STOP_MARKERS = _terms("""
related articles
more stories
categories
what's new @
what's new
most popular diys
most popular
electronics components
design guides
truly innovative tech
recent forum discussions
share your thoughts & comments
share your thoughts
cancel reply
previous article
next article
network consists of further focused websites
inspired by our flagship publication
checked out efy express
electronics news
most popular videos
calculators
comments
editor version
similar projects
эти статьи вам тоже могут пригодиться
все вопросы в форум
как вам эта статья
работоспособность сайта проверена в браузерах
""")

PRE_ARTICLE_MARKERS = _terms("""
编辑推荐
推荐帖子
资料下载
技术特刊
社区活动
厂商社区
华强pcb
华强芯城
电子搜索
邮件订阅
文章:新闻
下载:eda
栏目导航
""")

ZH_POST_CONTENT_MARKERS = _terms("""
技术专区
相关帖子
相关标签
关注此标签的用户
相关推荐
相关评论
可能感兴趣
关注本资料的网友
编辑推荐厂商产品技术软件
华强聚丰
my elecfans
产业
特色栏目
社群
供应链服务
媒体服务
关于本站
欢迎投稿
用户建议
版权申明
友情链接
下载排行榜
最新精华
原创博文
ee直播间
在线研讨会
最新资讯
热门推荐
热门资料
推荐白皮书
新帖速递
随便看看
热门标签
最新文章
热门资料推荐
开源项目
查找数据手册
站长推荐
阅读更多内容
本网页已闲置
扫码关注
声明：
本文转载自
热门词
创新实用技术专题
论坛热帖
活动中心
快速回复
返回顶部
面包版社区版主招募
有奖互动
上传资料得京东卡
查看他发布的资源
上传用户
下载次数
所需E币
立即下载
资料介绍
推荐星级
原文链接：
原文出处：
文章来源：
本文来源：
原文地址：
分享到：
微信 qq空间
新浪微博 腾讯微博
收藏(0)
打印
pcbway
""")

INLINE_NOISE_MARKERS = _terms("""
- advertisement -
telegram
whatsapp
watch this video on youtube
log in to leave a comment
please enter your comment
please enter your name here
you have entered an incorrect email address
please enter your email address here
save my name, email, and website
登录阅读全文
您需要登录后才可以回帖
回复 分享 举报
返回列表 发新帖 回复
发新帖 回复
查看更多>>
add the following snippet to your html
html code here
replace this with any non empty raw html code
sign in
log in
sign up
sign in / join
register
welcome! log into your account
welcome! register for an account
forgot your password
create an account
password recovery
recover your password
a password will be e-mailed to you
your username
your password
your email
资料大小：
所需积分：
推荐星级：
类别：
阅读数：
上传者：
面包板社区
阅读更多内容，狠戳这里
本网页已闲置
扫码关注
面包芯语
微信扫码支付
余额支付
给作者打赏
站点导航
全球网站
关注我们
免费订阅杂志
电子工程专辑
国际电子商情
电子技术设计
e media asia ltd
粤icp备
面包版社区版主招募
上传资料得京东卡
有奖互动
看视频学模拟
推荐白皮书
""")

PUBLIC_CONTENT_TERMS = _terms("""
emc
emi
pcb
ad
da
adc
dac
模拟地
数字地
布线
退耦
去耦
电流回路
""")

BROAD_QUERY_TERMS = _terms("""
ac
dc
ce
re
port
common
mode
optimization
architecture
design
differences
from
sense
sensing
charging
battery
cell
circuit
circuits
project
projects
design
selection
select
power
supply
current
voltage
capacitor
resistor
diode
schematic
electronics
troubleshooting
""")

GENERIC_ACRONYMS = _terms("""
AC
DC
LED
MOS
FET
MOSFET
BJT
IGBT
PNP
NPN
PWM
PFC
SMPS
PCB
GND
NTC
PTC
TVS
MOV
GDT
EMC
EMI
""")

GENERIC_MODEL_LIKE = _terms("""
type-c
usb-c
""")

LOW_VALUE_PROJECT_TITLES = _terms("""
lab supply2
flexipower
buck-boost multi-chemistry battery charger
""")

NOISE_MARKERS = _terms("""
object moved
404 not found
404 - file or directory not found
server error in '/' application
server error
the resource cannot be found
the resource you are looking for might have been removed
configuration error
temporarily unavailable
access denied
captcha
recaptcha
please log in
sign in
login
redirect
temporarily moved
permanently moved
add the following snippet to your html
<iframe
please wait
/images/ajax-loader.gif
images/ajax-loader.gif
content/images/ajax-loader
home * projects * hubs * components * forum
copyright ©
copyright (c)
privacy policy
cookie policy
terms of use
gnu general public license
gnu library general public license
gnu lesser general public license
open source initiative
do not show this message again
circuitmaker-prod
projectmetadata
add new maker
fabricate
download files
download files delete components files
prev * * * * next
community maker
""")

LOW_VALUE_SOURCES = _terms("""
circuitmaker.com/user/
circuitmaker.com/users/
circuitmaker.com/components/
circuitmaker.com/forum/
circuitmaker.com/stream
""")

PROJECT_SOURCES = _terms("""
circuitmaker.com/projects/
circuitmaker.com/projects/details/
""")

HIGH_VALUE_MARKERS = _terms("""
datasheet
application note
app note
schematic
layout
calculation
equation
formula
failure
fault
debug
troubleshoot
measurement
waveform
scope
引脚
原理图
布局
公式
计算
故障
异常
波形
""")

TECHNICAL_TERMS = _terms("""
mosfet
bjt
igbt
opamp
op-amp
lm358
tl431
ntc
ptc
led
pwm
adc
dac
buck
boost
flyback
charger
battery
current
sense
feedback
gate
source
drain
oscillator
filter
ground
thermal
电流
电压
反馈
采样
充电
振荡
滤波
栅极
运放
""")

TOPOLOGY_TERMS = _terms("""
buck
boost
flyback
charger
constant current
current source
rectifier
bridge rectifier
inrush
soft start
precharge
feedback
current sense
op amp
oscillator
led driver
power supply
switching power supply
mosfet
op amp
opamp
tvs
mov
gdt
""")

FAULT_TERMS = _terms("""
burn
burns
burned
overheat
overheating
ripple
noise
spike
oscillation
unstable
short
open
inrush
surge
发热
烧
烧毁
纹波
噪声
尖峰
振荡
短路
开路
""")

DIAGNOSIS_MARKERS = _terms("""
故障分析
异常原因
失效机制
失效分析
烧毁原因
过热原因
不工作原因
维修方法
维修步骤
排查步骤
故障诊断
反馈环路
补偿计算
恒流原理
恒压原理
反激原理
开关电源原理
BUCK电路
BOOST电路
LLC谐振
选型计算
参数计算
NTC选型
浪涌计算
缓启动设计
纹波计算
尖峰抑制
EMI滤波
datasheet
application note
app note
pin function
typical application
reference design
evaluation board
design guide
TL431
LM358
UC3842
SG3525
IR2110
电路原理
电路分析
电路设计
波形分析
电路故障
""")

DEPTH_MARKERS = _terms("""
=
/
*
+
-
approx
delta
计算公式
推导过程
设计实例
实测波形
示波器
万用表
调试记录
实验验证
vout
iout
vin
iin
vref
iref
vds
vgs
rds
fsw
duty
frequency response
bode plot
phase margin
gain margin
crossover frequency
transfer function
pole
zero
step response
load transient
thermal
junction temperature
heatsink
derating
soa
safe operating area
""")

CAUSAL_MARKERS = _terms("""
因为
所以
导致
引起
使得
造成
促进
增强
抑制
减小
抵消
改善
降低
提升
提高
防止
避免
because
therefore
causes
results in
leads to
prevents
reduces
increases
""")

QA_MARKERS = _terms("""
请问
请教
如何解决
怎么处理
为什么
答
回答
回复
解决方案
解决方法
how to
solution
answered
resolved
""")

CHUNK_KEYWORDS = _terms("""
电路
电压
电流
电阻
电容
MOS
二极管
三极管
滤波
反馈
振荡
稳压
电源
信号
PWM
ADC
DAC
运放
比较器
充电
放电
导通
截止
开关
频率
增益
纹波
尖峰
噪声
环路
回路
恒流
恒压
补偿
采样
限流
保护
驱动
TL431
LM358
STM32
BUCK
BOOST
flyback
buck
boost
circuit
voltage
current
resistor
capacitor
inductor
op amp
transistor
diode
filter
feedback
oscillator
regulator
power
amplifier
converter
charger
sensor
relay
transformer
схема
усилитель
стабилизатор
транзистор
конденсатор
резистор
диод
""")

QUICK_CHECK_TERMS = _terms("""
故障分析
异常原因
失效机制
失效分析
烧毁原因
过热原因
不工作原因
维修方法
维修步骤
排查步骤
故障诊断
反馈环路
补偿计算
恒流原理
恒压原理
反激原理
开关电源原理
BUCK电路
BOOST电路
LLC谐振
选型计算
参数计算
NTC选型
浪涌计算
缓启动设计
纹波计算
尖峰抑制
EMI滤波
电路原理
电路分析
电路设计
波形分析
电路故障
datasheet
application note
app note
pin function
typical application
reference design
evaluation board
design guide
schematic
circuit diagram
power supply
amplifier
oscillator
voltage regulator
led driver
motor driver
sensor module
pwm controller
mcu
microcontroller
converter
inverter
charger
battery
relay
transformer
diode
transistor
capacitor
resistor
inductor
op amp
opamp
arduino
stm32
esp32
raspberry
buck
boost
flyback
forward
llc
tl431
lm358
lm324
lm393
uc3842
sg3525
ir2110
ir2153
ne555
lm78
lm1117
ams1117
irf540
irf
ao340
pc817
el817
4n25
moc302
bta16
bt136
2n2222
2n3904
lm2596
lm2576
xl4015
mp1584
mt3608
pre-amplifier
audio amplifier
battery charger
temperature sensor
humidity sensor
gas sensor
co2 sensor
motion sensor
ir sensor
reflow oven
soldering
pcb
circuit
схема
усилитель
генератор
питание
стабилизатор
транзистор
микросхема
конденсатор
резистор
диод
реле
трансформатор
радио
""")

FAILURE_PATTERNS = _terms("""
cloudflare
captcha
access denied
403 forbidden
forbidden
required part couldn't load
target url returned error 404
http 错误 404
404.0 - not found
enable javascript
please enable cookies
checking your browser
verify you are human
""")

BOILERPLATE_PATTERNS = _terms("""
accept cookies
cookie policy
privacy policy
terms of use
sign in
log in
subscribe
newsletter
advertisement
skip to content
toggle navigation
select language
all rights reserved
contact us
share this
社区首页
全部新帖
资料区
社区活动
联系管理员
专业技术中心
公司介绍
产品选型
联系我们
当前位置
返回首页
""")

NAV_WORDS = _terms("""
home
products
product
solutions
support
resources
applications
company
about
login
register
cart
menu
search
forum
blog
download
pricing
""")

MOJIBAKE_MARKERS = _terms("""
Ã
Â
�
ï¼
ã€
å
æ
ç
é
è
""")

FORUM_NOISE_PATTERNS = _terms("""
请 [登录]
快捷导航
没有帐号
最后登录
在线时间
芯积分
E金币
复制链接
下载附件
保存到相册
只看该作者
当前离线
扫一扫
""")

NOISE_CONTENT_PATTERNS = _terms("""
网站地图
站点地图
sitemap
精品范文
学术之家
最新作品发布时间
综合视频
认证徽章
抖音综合搜索
""")

LOW_VALUE_SEARCH_HOSTS = _terms("""
www.douyin.com
douyin.com
www.xueshu.com
xueshu.com
www.rcmoy.com
rcmoy.com
www.scribd.com
scribd.com
www.taobao.com
taobao.com
detail.tmall.com
www.tmall.com
www.jd.com
jd.com
item.jd.com
www.amazon.com
amazon.com
""")

LOW_VALUE_SEARCH_PATHS = _terms("""
/search/
/sitemap
sitemap.
/tag/
/tags/
/tag_
""")

LOW_VALUE_SEARCH_TITLES = _terms("""
网站地图
站点地图
sitemap
搜索
抖音
快手
淘宝
天猫
好货
店铺
通用
12篇
范文
""")

SEARCH_STOP_TERMS = _terms("""
怎么
为什么
什么
问题
原因
处理
维修
电路
使用
指南
设计
拆解
内部
""")

READ_NAV_WORDS = _terms("""
home
products
product
solutions
support
resources
applications
company
about
login
register
cart
menu
search
forum
download
""")

ENTITY_STOPWORDS = _terms("""
一个
一般
不是
不能
主要
也会
以及
但是
例如
可能
因此
如果
存在
导致
建议
应该
或者
所以
检查
检测
测量
进行
这个
这里
需要
问题
异常
正常
原因
影响
可以
是否
没有
出现
相关
由于
通过
分析
判断
确认
结论
依据
具体
实际
部分
方式
情况
作用
位置
方法
方案
处理
改善
功能
实现
增加
降低
提高
选择
采用
使用
注意
风险
不确定性
""")

LOW_VALUE_SUFFIXES = _terms("""
情况
问题
原因
作用
现象
建议
方法
位置
方案
处理
部分
功能
""")

DOMAIN_ABBREVS = _terms("""
mos
esr
esl
emi
pwm
llc
ntc
ptc
led
tvs
gdt
mov
pcb
buck
boost
ldo
adc
dac
mcu
bms
igbt
sic
gan
gnd
vcc
vdd
vin
vout
vf
sw
rc
lc
snubber
""")

# Query expansion: term found in the query -> terms added to it.
QUERY_EXPANSIONS = {
    '电流采样': ('current sense', 'current sensing', 'sense resistor', 'shunt'),
    '采样电阻': ('sense resistor', 'shunt resistor', 'current sense'),
    '采样': ('sense', 'sensing', 'feedback'),
    '电流检测': ('current sense', 'current monitor', 'current measurement'),
    '运放': ('op amp', 'opamp', 'operational amplifier', 'amplifier'),
    '放大器': ('amplifier', 'op amp'),
    '负反馈': ('negative feedback', 'feedback loop', 'closed loop'),
    '反馈': ('feedback', 'feedback loop'),
    '补偿': ('compensation', 'loop compensation'),
    '振荡': ('oscillation', 'oscillator', 'unstable'),
    '震荡': ('oscillation', 'oscillator', 'unstable'),
    '噪声': ('noise', 'ripple', 'spike'),
    '纹波': ('ripple', 'noise'),
    '滤波': ('filter', 'filtering', 'low pass'),
    '充电': ('charger', 'charging', 'battery charger'),
    '电池': ('battery', 'cell'),
    '指示灯': ('LED', 'status LED', 'indicator'),
    '状态灯': ('status LED', 'indicator', 'LED'),
    '发光二极管': ('LED', 'light emitting diode'),
    '浪涌': ('inrush', 'surge', 'inrush current'),
    '冲击电流': ('inrush current', 'surge current'),
    '整流桥': ('bridge rectifier', 'rectifier bridge'),
    '整流': ('rectifier', 'rectification'),
    '保险丝': ('fuse', 'fusing'),
    '热敏': ('NTC', 'thermistor'),
    '缓启动': ('soft start', 'soft-start', 'startup'),
    '软启动': ('soft start', 'soft-start', 'startup'),
    '预充': ('precharge', 'pre-charge'),
    '恒流': ('constant current', 'current source'),
    '恒压': ('constant voltage', 'voltage regulation'),
    '电源': ('power supply', 'supply', 'power'),
    '开关电源': ('switching power supply', 'SMPS', 'switch mode power supply'),
    '降压': ('buck', 'step down'),
    '升压': ('boost', 'step up'),
    '反激': ('flyback',),
    '栅极': ('gate', 'gate drive'),
    '漏极': ('drain',),
    '源极': ('source',),
    '场效应管': ('MOSFET', 'FET'),
    '三极管': ('transistor', 'BJT'),
    '二极管': ('diode',),
    '稳压': ('regulator', 'voltage regulation', 'zener'),
    '过热': ('overheat', 'overheating', 'thermal'),
    '发热': ('heat', 'heating', 'thermal'),
    '短路': ('short circuit', 'short'),
    '开路': ('open circuit', 'open'),
    '接地': ('ground', 'GND'),
    '地线': ('ground', 'GND'),
    '上拉': ('pull up', 'pull-up'),
    '下拉': ('pull down', 'pull-down'),
}

# Spelling variants folded while normalising entity text, applied in this order.
TOKEN_ALIASES = {
    'mosfet': 'mos',
    '场效应管': 'mos',
    'mos管': 'mos',
    '闸极': '栅极',
    '门极': '栅极',
    '发烫': '过热',
    '发热': '过热',
    '温升异常': '过热',
    '自激': '振荡',
    '啸振': '振荡',
    '肖特基管': '肖特基二极管',
    '欧姆': 'ohm',
    'ω': 'ohm',
    'Ω': 'ohm',
    'μ': 'u',
}


# Line patterns removed from pages of a host ("*" = every host).
HOST_LINE_PATTERNS = {
    ('*',): _terms(r"""
(?i)^\s*(立即登录|注册|登录|Sign\s*Up|Sign\s*In|Login|Log\s*In)\s*$
^\s*!\[.*?\]\(.*?\)\s*$
^\s*[*\s]*$
^\s*广告\s*$
(?:上一篇|下一篇|相关推荐|热门推荐|相关文章|Related\s*Articles|Related\s*Posts)\s*$
"""),
    ('elecfans.com', 'www.elecfans.com'): _terms(r"""
发表于\s*\d{4}-\d{2}-\d{2}\s*[•·]\s*\d+次阅读
\d{4}-\d{2}-\d{2}\s*[•·]\s*\d+次阅读
\d+次阅读
次下载
下载该资料的人也在下载|下载该资料的人还在阅读
免费下载.*(?:PDF|pdf).*电子书
专栏\s+电子说\s+商业评论
电子发烧友网\s*>
skin\.elecfans\.com|skin-2012|file\.elecfans\.com
电子资料下载频道.*为电子工程师
电子技术应用频道.*为电子工程师
专业的电子元器件平台.*及时发布
电路图频道.*提供电子电路图
构建电子工程师交流的平台
电阻器\s+电容器\s+电感器
接口定义.*芯片引脚图.*元件代换.*光耦
您好，欢迎来.*电子发烧友网
请输入元器件型号
电子搜索
^\s*首页\s*最新更新\s*电子百科\s*电子问答
^\s*(?:首页|最新更新|电子百科|电子问答|网站导航)\s*$
"""),
    ('bbs.eeworld.com.cn', 'www.eeworld.com.cn', 'eeworld.com.cn'): _terms(r"""
设为首页|收藏本站|EEWORLD首页
社区导航|技术讨论创新帖|全部新帖|干货|资料区
快捷导航
单片机\s+物联网\s+汽车电子\s+嵌入式
^\s*(?:首页|技术|应用)\s*_\|_\s*$
热门技术文章|热门应用文章|今日技术|今日应用
^\s*###\s*技术分类\s*$
^\s*###\s*应用分类\s*$
!\[.*?\]\([\./]?static/
!\[.*?\]\(http[s]?://[^/]*\.eeworld[^/]*\.cn/static/
复制链接
使用道具\s*举报
验证码|安全验证|请输入验证码
发帖|回帖|签到|打卡
高级搜索
\*\*推荐资源\*\*|推荐资源|相关帖子|相关推荐|###\s*推荐资源|###\s*相关帖子
您需要登录后才可以|登录\s*\|\s*立即注册
^\s*\|.*\|.*\|$
下载次数|资源积分|资源大小|上传时间|上传者
^\s*!\[.*?\]\(http://download\.eeworld\.com\.cn/
评分|收藏|分享|举报
最新活动|TI直播|ADI之路|主题游|打卡
本帖最后由.*于.*编辑
_\s*回复\s*_|_\s*使用道具\s*_|_\s*举报\s*_
^\s*\d+\s*$
楼主|沙发|板凳|地板|地下室|下水道
^\s*<.*>\s*$
小喇叭|提醒|消息
当前离线|当前在线
一粒金砂(?:（(?:初级|中级|高级|入门)）)?|超级版主|版主|管理员
^\s*\S+\s+\*?\*\*\S+\*?\*\*\s*_?(?:当前离线|当前在线)_?\s*
^\s*>\s*\S+\s+发表于\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}
本帖子中包含更多资源|感谢有你|愿一路同行|翻开《
!\[.*?\]\(http://download\.eeworld\.com\.cn/images/
有奖直播|任选下载有礼|TI 嵌入式研讨会集锦|ams投影
测评.*!\(.*?static/image/common/new\.gif
来源：EEWorld|转载请附上链接
查看:\s*\d+\s*\|\s*回复:\s*\d+
^\s*---\|---(?:\|---)*\s*$
^\s*\d+\s*$
^\s*_\s*_\s*_\s*$
"""),
    ('www.eet-china.com', 'eet-china.com', 'mbb.eet-china.com'): _terms(r"""
电子技术社区|技术社区|EE社区|电子工程社区
电子工程专辑|国际电子商情|电子技术设计|CEO专栏
杂志免费订阅|EE\|Times\s*全球联播
在线研讨会|白皮书|小测验|资源中心|每月抽奖
最新发表\s*推荐阅读\s*明星博主
^\s*写博文\s*$
文章：\*\*\d+\*\*\s*阅读：\*\*\d+\*\*
^\s*\d+\s*$
好友\s+私信\s+个人主页
^\s*(?:FPGA|MCU|模拟|电源|测试|通信|PCB|汽车|消费|智能|物联网|软件|采购|供应链|职场|EDA|无人机|机器人|AI|医疗|工业)\s*
^\s*原创\s*\d+\s*$
抗击肺炎专题
最新帖子\s+问答\s+下载\s+更多
文章评论|条评论
您需要登录后才可以|登录\s*\|\s*立即注册
当前离线|离线|在线|\d+小时|\d+枚\(兑换\)
^\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s*$
^\s*###\s*评论\s*$
复制链接|分享到|举报|收藏
^\s*\|.*\|.*\|$
评分|收藏|分享|举报
查看:\s*\d+\s*\|\s*回复:\s*\d+
_\s*回复\s*_|_\s*使用道具\s*_|_\s*举报\s*_
"""),
    ('radiokot.ru', 'radiokot.ru:81'): _terms(r"""
РадиоКот\s*>|РадиоКот\s*::\s*Главная
Здравствуйте.*Разрешите представиться
Главная\s*Схемы\s*Лаборатория\s*Статьи\s*Обучалка
Ссылки\s*Справочник\s*КотАрт\s*О\s*проекте\s*Форум
datasheet\.png|find\.png
Мои\s+чокнутые\s+хозяева
А\s+здесь\s+Коту\s+наливали\s+пива
Технологии\s+BUGS
Радио-схемы.*Мануалы.*Справочники.*Форум
^\s*(?:Главная|Схемы|Лаборатория|Статьи|Обучалка|Ссылки|Справочник|КотАрт|Форум)\s*$
"""),
    ('circuitmaker.com',): _terms(r"""
Loading project.*Please wait
Blog\s+Documentation\s+Download\s+Service\s+Status
Home\s+Projects\s+Hubs\s+Components\s+Forum
Share\s+by\s+email
Your\s+message\s+was\s+succesfully\s+sent
Thumb\s+up\s+Edit\s+Delete
!\[.*?\]\(/Content/Images/(?:Social|ajax-loader|logo)
Overview\s+Design\s+Team\s+Components
From\s+To\s+Subject\s+Body\s+Send\s+Close
(?i)^\s*(?:Sign\s*in|Overview|Design|Team|Components)\s*$
"""),
    ('www.hackster.io', 'hackster.io'): _terms(r"""
(?i)^\s*(?:Sign\s*in|Log\s*in|Register|Join)\s*$
Explore\s+Projects\s+Contests\s+Events
!\[.*?\]\(https://hackster\.io/static/
"""),
    ('oshwlab.com',): _terms(r"""
Home\s+Explore\s+Post\s+Forum
Share\s+Project
Login\s+\|\s+Register
Open\s+all\s+in\s+editor
Recent searches
^\s*(?:Home|Explore|Post|Forum|Share)\s*$
"""),
    ('www.electronicsforu.com', 'electronicsforu.com'): _terms(r"""
Subscribe\s+to\s+our\s+Newsletter
(?i)^\s*(?:Login|Register|Sign\s*in)\s*$
^\s*\|.*\|.*\|$
^\s*---\|---(?:\|---)*\s*$
Share\s+this\s+article|Related\s+Projects|Popular\s+Posts
View\s+All|More\s+Projects|Recommended\s+For\s+You
"""),
}

HOST_ALLOWED_PATHS = {
    'elecfans.com': ('/article/', '/dianlutu/', '/analog/', '/power/', '/emc/', '/eda/', '/yuanqijian/', '/soft/', '/jiekou/'),
    'www.elecfans.com': ('/article/', '/dianlutu/', '/analog/', '/power/', '/emc/', '/eda/', '/yuanqijian/', '/soft/', '/jiekou/'),
    'bbs.eeworld.com.cn': ('/thread-', '/drycargo/'),
    'www.eeworld.com.cn': ('/drycargo/',),
    'eeworld.com.cn': ('/drycargo/',),
    'www.eet-china.com': ('/blog/', '/ART_', '/news/'),
    'mbb.eet-china.com': ('/blog/',),
    'eet-china.com': ('/blog/', '/ART_'),
    'radiokot.ru': ('/circuit/', '/articles/'),
    'radiokot.ru:81': ('/circuit/', '/articles/'),
    'circuitmaker.com': ('/Projects/Details/',),
    'oshwlab.com': ('/',),
    'www.hackster.io': ('/',),
    'hackster.io': ('/',),
    'www.electronicsforu.com': ('/electronics-projects/', '/electronicsforu/circuitarchives/', '/design-guides/', '/resources/'),
    'electronicsforu.com': ('/electronics-projects/', '/electronicsforu/circuitarchives/', '/design-guides/', '/resources/'),
}

HOST_REJECT_PATHS = {
    'elecfans.com': ('/tag/', '/category/', '/company/', '/download/', '/bbs/', '/forum/', '/user/'),
    'www.elecfans.com': ('/tag/', '/category/', '/company/', '/download/', '/bbs/', '/forum/', '/user/'),
    'bbs.eeworld.com.cn': ('/forum/', '/user/', '/space/', '/group/'),
    'www.eet-china.com': ('/ace/', '/contest/', '/magazine/', '/subscribe/'),
    'eet-china.com': ('/ace/', '/contest/', '/magazine/', '/subscribe/'),
    'mbb.eet-china.com': ('/forum/', '/group/', '/activity/', '/contest/'),
    'circuitmaker.com': ('/Blog/', '/Documentation/', '/Forum/', '/Users/', '/Components/', '/stream/', '/Hubs', '/About'),
    'www.hackster.io': ('/live/', '/contests/', '/channels/', '/products/'),
    'hackster.io': ('/live/', '/contests/', '/channels/', '/products/'),
    'oshwlab.com': ('/forum/', '/activity/'),
    'radiokot.ru': ('/forum/', '/search/', '/adv/'),
    'www.electronicsforu.com': ('/tag/', '/category/', '/author/'),
    'electronicsforu.com': ('/tag/', '/category/', '/author/'),
}

HOST_REJECT_TITLES = {
    'elecfans.com': ('提示信息', '404', '电子发烧友网', '电子搜索'),
    'www.elecfans.com': ('提示信息', '404', '电子发烧友网', '电子搜索'),
    'bbs.eeworld.com.cn': ('提示信息', '安全验证', '404', 'EEWORLD首页'),
    'www.eet-china.com': ('ACE Awards', 'Subscription Corner', '404', 'EETC首页'),
    'eet-china.com': ('ACE Awards', 'Subscription Corner', '404', 'EETC首页'),
    'mbb.eet-china.com': ('面包板首页', '广告', '404', '提示信息'),
    'circuitmaker.com': ('Loading project', 'Sign in', 'Error', '404'),
    'www.hackster.io': ('Hackster Hardware Meetup', 'User Profile', '404', 'Sign in'),
    'hackster.io': ('Hackster Hardware Meetup', 'User Profile', '404', 'Sign in'),
    'radiokot.ru': ('Главная', 'РадиоКот :: Главная', 'Поиск', 'Форум'),
    'oshwlab.com': ('EasyEDA open source hardware lab', 'OSHWLab', 'Login'),
    'www.electronicsforu.com': ('404', 'Subscribe', 'Newsletter'),
    'electronicsforu.com': ('404', 'Subscribe', 'Newsletter'),
}

SIGNAL_TERMS = _terms("""
voltage
current
input
output
datasheet
amplifier
comparator
resistor
capacitor
frequency
gain
offset
power
supply
circuit
package
temperature
typical
maximum
minimum
电压
电流
电源
电路
电感
电容
反馈
纹波
开关
运放
比较
布局
布线
""")

TRUSTED_HOSTS = _terms("""
www.elecfans.com
elecfans.com
bbs.eeworld.com.cn
www.eeworld.com.cn
www.eet-china.com
mbb.eet-china.com
electronicsforu.com
www.electronicsforu.com
www.hackster.io
www.allaboutcircuits.com
www.edn.com
""")

NOISE_HEADING_WORDS = _terms("""
404
301
page not found
object moved
categories
what's new
most popular
electronics components
design guides
truly innovative
calculators
技术专区
相关推荐
热门推荐
logo
电子发烧友网logo
electronics for you
技术
应用市场
产业
特色栏目
社群
媒体服务
供应链服务
""")

HTML_SEARCH_TERMS = _terms("""
tl431
光耦
纹波
电源
电路
反馈
补偿
反激
限流
电流检测
电阻
电容
开关电源
谐振
ripple
supply
feedback
compensation
flyback
current sense
current sensing
resistor
capacitor
optocoupler
rc filter
""")

HTML_SEARCH_BAD_TERMS = _terms("""
limited liability
registered agent
llc formation
business entity
irs
investopedia
forbes
legalzoom
company
powerball
lottery
""")

NAV_LINE_ITEMS = _terms("""
home
forums
help
search
about us
contact us
projects (diy)
explore
specials
channels
what's new
jobs & careers
login
register
about us
subscribe
editor version
share project
recent searches
activity
article
post
profile
friends
team
following
followers
documents
bonsai
bom
главная
схемы
лаборатория
статьи
обучалка
ссылки
справочник
о проекте
форум
首页
论坛
下载
博客
评测
视频
技术
资源
厂商
电子论坛
电子说
学院
芯城
pcb
smt
最新更新
专栏
社区首页
面包板社区
面包芯语
电子工程专辑
国际电子商情
电子技术设计
在线研讨会
技术白皮书
厂商社区
技术小站
社区活动
厂商活动
""")

SOCIAL_LINE_ITEMS = _terms("""
facebook
linkedin
twitter
instagram
telegram
whatsapp
email
print
youtube
vimeo
""")

LEGAL_MARKERS = _terms("""
home * projects * hubs * components * forum
/images/ajax-loader.gif
gnu general public license
gnu library general public license
gnu lesser general public license
privacy policy
cookie policy
do not show this message again
add new maker
download files delete components files
""")

FORUM_AGGREGATION_MARKERS = _terms("""
个人签名
默认摸鱼
ta的资源
最新帖子
最新回复
技术支持
本帖最后由
官方资源
欢迎大家推荐资源
返回列表
我要发帖
切换旧版
""")

COMPRESS_DROP_PATTERNS = _terms(r"""
发表于\s*\d{4}-\d{2}-\d{2}\s*•\s*\d+次阅读
\d+次阅读
次下载
下载该资料的人也在下载
下载该资料的人还在阅读
免费下载.*(?:PDF|pdf).*电子书
热门推荐|相关推荐|相关文章|相关阅读
上一篇|下一篇
!\[.*?\]\([^)]*load\.\w+\)
!\[.*?\]\([^)]*eye\.\w+\)
!\[电子发烧友网Logo\]
\d+\s*•\s*\d+次阅读
---[|]*---
专栏\s+电子说\s+商业评论
电子发烧友网\s*>
skin\.elecfans\.com|skin-2012
file\.elecfans\.com
(?i)^\s*(立即登录|注册|登录|Sign\s*Up|Sign\s*In)\s*$
^\s*(快捷导航|社区导航|搜索中心)\s*$
^\s*!\[.*?\]\(.*?\)\s*$
^\s*[*\s]*$
""")

CAUSAL_PATTERNS = _terms(r"""
因为.+所以
(?:导致|引起|使得|造成|促进|增强|抑制|减小|抵消|改善|降低|提升|提高|防止|避免|用于|用来|用于滤除|主要作用是|也称|具体包括)
[A-Za-z]+\s*[→=>]\s*[A-Za-z]+
(?i)\b(?:formula|equation|Vout|Vin|Iout|f_c|fsw|duty|gain|phase|margin|pole|zero|compensation)\b
""")


@dataclass(frozen=True)
class Lexicons:
    """The term lists an operator works with; every field can be replaced."""

    noise: tuple[str, ...] = NOISE_MARKERS
    legal: tuple[str, ...] = LEGAL_MARKERS
    high_value: tuple[str, ...] = HIGH_VALUE_MARKERS
    technical: tuple[str, ...] = TECHNICAL_TERMS
    public_content: tuple[str, ...] = PUBLIC_CONTENT_TERMS
    topology: tuple[str, ...] = TOPOLOGY_TERMS
    fault: tuple[str, ...] = FAULT_TERMS
    diagnosis: tuple[str, ...] = DIAGNOSIS_MARKERS
    broad: tuple[str, ...] = BROAD_QUERY_TERMS
    acronyms: tuple[str, ...] = GENERIC_ACRONYMS
    model_like: tuple[str, ...] = GENERIC_MODEL_LIKE
    low_value_sources: tuple[str, ...] = LOW_VALUE_SOURCES
    project_sources: tuple[str, ...] = PROJECT_SOURCES
    project_titles: tuple[str, ...] = LOW_VALUE_PROJECT_TITLES
    embed_marker: str = "add the following snippet to your html"
    section_stops: tuple[str, ...] = SECTION_STOP_MARKERS + EN_SECTION_STOP_MARKERS
    section_stops_cased: tuple[str, ...] = ZH_POST_CONTENT_MARKERS
    line_drops: tuple[str, ...] = (
        BOILERPLATE_LINE_MARKERS + PRE_ARTICLE_MARKERS + INLINE_NOISE_MARKERS
    )
    reject_titles: tuple[str, ...] = REJECT_TITLES
    reject_paths: tuple[str, ...] = REJECT_PATH_PARTS + REJECT_PATH_SUBSTRINGS
    noise_headings: tuple[str, ...] = NOISE_HEADING_WORDS
    nav_items: tuple[str, ...] = NAV_LINE_ITEMS + SOCIAL_LINE_ITEMS
    depth: tuple[str, ...] = DEPTH_MARKERS
    causal: tuple[str, ...] = CAUSAL_MARKERS
    qa: tuple[str, ...] = QA_MARKERS
    chunk_keywords: tuple[str, ...] = CHUNK_KEYWORDS
    quick_check: tuple[str, ...] = QUICK_CHECK_TERMS
    failure: tuple[str, ...] = FAILURE_PATTERNS
    boilerplate: tuple[str, ...] = BOILERPLATE_PATTERNS
    nav_words: tuple[str, ...] = NAV_WORDS
    mojibake: tuple[str, ...] = MOJIBAKE_MARKERS
    forum_noise: tuple[str, ...] = FORUM_NOISE_PATTERNS
    aggregation: tuple[str, ...] = NOISE_CONTENT_PATTERNS
    signal: tuple[str, ...] = SIGNAL_TERMS
    low_value_hosts: tuple[str, ...] = LOW_VALUE_SEARCH_HOSTS
    low_value_paths: tuple[str, ...] = LOW_VALUE_SEARCH_PATHS
    low_value_titles: tuple[str, ...] = LOW_VALUE_SEARCH_TITLES
    trusted_hosts: tuple[str, ...] = TRUSTED_HOSTS
    search_stop: tuple[str, ...] = SEARCH_STOP_TERMS
    read_nav: tuple[str, ...] = READ_NAV_WORDS
    forum_aggregation: tuple[str, ...] = FORUM_AGGREGATION_MARKERS
    compress_drops: tuple[str, ...] = COMPRESS_DROP_PATTERNS
    causal_patterns: tuple[str, ...] = CAUSAL_PATTERNS
    abbrevs: tuple[str, ...] = DOMAIN_ABBREVS
    entity_stop: tuple[str, ...] = ENTITY_STOPWORDS
    low_value_suffixes: tuple[str, ...] = LOW_VALUE_SUFFIXES
    html_terms: tuple[str, ...] = HTML_SEARCH_TERMS
    html_bad_terms: tuple[str, ...] = HTML_SEARCH_BAD_TERMS


DEFAULT = Lexicons()
