"""Labelled spans made for the tagger, and its training: ``python -m ferrule.llm.p3_train TABLES``.

TABLES is a folder with documents.parquet, whose sentences, at most BACKGROUND of them, are the text
around the made mentions.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter

import numpy as np

from .p3_tagger import KINDS, Tagger, folded_codes

BACKGROUND = 40_000
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖文冼甄臧祁阮岑邬厉葛桑裴滕娄鄢闵柴"
GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红玲芬燕彬斌浩宇轩子涵梓雨欣怡佳思晨博文俊辉建国志梅兰琴云莲真环雪荣爱妹香月莺媛瑞凡雅雯莉洁颖露瑶怡婵雁蓓仪荷丹蓉眉君琴蕊薇菁梦岚苑婕馨瑗琰韵融园艺咏卿聪澜纯毓悦昭冰爽琬茗羽希宁欣飘育滢馥筠柔竹霭凝晓欢霄枫芸菲寒伊亚宜可姬舒影荔枝恺昀瑾禾桐菡芮骞铭屿弈歆煦穗烨霖笙远峰鹏飞凯亮成东林波新海山世中少卫永健义祥福全生龙元江昌庆有贵达兵胜友富顺良才根喜长利仁旭松金鑫珊蕾倩婷丹慧巧美娜"
SYLLABLES = "quil qui ox hawt tav net tun bra mer wyn tam ros ils bren zel yor la ta le si my al an ar bel ber bran bry cal car cor dal dor dun ed el en fal far gar gil har hal hol is jo ka kel lan len lin lor mal mar mer mor nel nor ol or os pel per ral ren ro sab sel tam tes thes tor ul val ver wyn yor zel".split()
ENDINGS = "a an by croft dale den don er field ford gate ham ingham is key land ley low man mere moor more nor on quay ra row sa sen sleeve son ton trell vane wall way well wick wood worth".split()
FIRST = """Anna Ben Carl Dora Eve Frank Grace Henry Iris Jack Karen Leo Maria Nina Oscar Paul Rose Sam Tina Victor Wendy James Mary Robert Patricia
John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Christopher Lisa Nancy Matthew Betty
Anthony Sandra Mark Ashley Donald Emily Steven Kimberly Andrew Helen Joshua Donna Kenneth Michelle Kevin Carol Brian Amanda George Melissa Timothy
Deborah Ronald Stephanie Jason Rebecca Edward Laura Ryan Cynthia Nicole Amir Chen Diego Elena Fatima Hiroshi Ingrid Jamal Katya Luca Mei Noor Olga Priya
Rahul Sofia Tariq Ursula Yusuf Zoe Kwame Aisha Bjorn Chloe Emeka Farah Greta Hassan""".split()
LAST = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson
White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell
Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes Stewart Morris Murphy Cook Rogers Morgan Cooper Peterson Bailey Reed Kelly
Howard Ramos Kim Cox Ward Watson Brooks Bennett Gray Mendoza Hughes Price Myers Long Foster Sanders Ross Powell Sullivan Russell Ivanov Kowalski Schmidt
Rossi Tanaka Sato Singh Patel Khan Haddad Mensah Adeyemi Nakamura Lindqvist Dubois Moreau Fischer Weber Novak Costa Silva Osei Petrov""".split()
CITIES_ZH = """北京 上海 天津 重庆 广州 深圳 杭州 南京 武汉 成都 西安 苏州 郑州 长沙 沈阳 青岛 宁波 东莞 无锡 佛山 合肥 大连 福州 厦门 哈尔滨 济南 温州 南宁
长春 泉州 石家庄 贵阳 南昌 金华 常州 南通 嘉兴 太原 徐州 惠州 珠海 中山 台州 烟台 兰州 绍兴 海口 扬州""".split()
PROVINCES_ZH = "河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海".split()
ROADS_ZH = "大道 路 街 北路 南路 东路 西路 巷 胡同 里".split()
ROAD_WORDS_ZH = "银杏 望潮 枫桥 听雨 桐花 柳汀 砚池 人民 中山 建设 和平 解放 文化 新华 长江 黄河 学府 青年 光明 春晖 迎宾 滨河 朝阳 翠竹".split()
PLACE_ZH = "云泊鹿霁临青溟浦阳川棠泽南北东西江海河湖山林石桥石渡溪荫望湖白鹭新安宁平和长春永丰华兴城"
ROADS_EN = "Street Road Lane Avenue Drive Way Crescent Close Court Hill Boulevard Place Terrace".split()
DIGITS_ZH = "零一二三四五六七八九"

# Sentences with a mention; {x} stands for it. The first of each pair of lists is Chinese.
CARRIERS = {
    "email": (
        "邮箱：{x}。|请把材料发到{x}，逾期不候。|如未收到回执，可写信至{x} 说明情况。|签名档里只有{x}这一行。|她常用的账号为 {x} ，已停用。|发件人<{x}>要求撤回。|抄送（{x}）。|申请人留下的联系方式是{x}。|联系邮件：{x}|发送到 {x} 即可。|电子邮件{x}已失效。|回信地址 {x}，谢谢。|请回复{x}",
        "E-mail: {x}|Send the form to {x} before Friday.|The sender <{x}> wants it back.|(cc {x})|Her old account {x} is closed.|The customer wrote from {x} twice.|Nothing but {x} stood in the footer.|Please write to {x}.|Reply to {x} today.|Mail {x} for details.|His address is {x}, I think.|Contact {x}"),
    "phone": (
        "电话：{x}。|来电显示{x}，未接通。|本人手机{x}，白天可接。|收货方（{x}）拒签。|回访号码为{x}，请在晚间拨打。|她说打{x}就能找到。|紧急联系{x}，备用线路略。|微信同号 {x}。|短信已发至{x}。|手机号{x}已停机。|联系电话 {x}|请拨打{x}咨询。|座机{x}无人接听。|热线是{x}。",
        "Phone: {x}|The number on the slip is {x}, please try again.|A text went to {x} at noon.|She can be reached under {x}.|Missed: {x} (twice).|Call {x} after six.|The courier ({x}) refused.|Tel. {x}|Ring {x} in the evening.|Fax {x} is broken.|My mobile is {x}.|Dial {x} for help."),
    "id_number": (
        "身份证号：{x}。|证件号码{x}已核验。|开户资料（{x}）缺页。|登记表上填的是{x}，请补盖章。|复印件显示{x}，字迹模糊。|持{x}办理了领用手续。|身份证 {x} 已过期。|本人证件{x}。|实名信息为{x}。|证号是{x}",
        "Identity number: {x}.|A copy showing {x} is blurred.|The form says {x}, which still needs a stamp.|Presented {x} at the desk.|The card {x} was checked.|His ID {x} expired.|Social security number {x}|Registered under {x}."),
    "address": (
        "住址：{x}。|上门维修地点在{x}，需提前预约。|她搬到了{x}，请改派。|样机送至{x}后签收。|户籍登记为{x}，与合同一致。|快递请寄往{x}。|地址是{x}。|收货地址 {x}|家住{x}。|现居{x}，已婚。|寄到{x}即可。",
        "Home address: {x}.|She moved to {x} last week.|The parcel left for {x} and came back.|Ship the spare to {x}.|The repair is booked at {x}, by appointment.|He lives at {x}.|Deliver to {x}|Their house, {x}, was sold.|Send it to {x}."),
    "name": (
        "联系人：{x}。|{x}先生当天来电投诉。|由{x}女士签收。|这份单子是{x}写的。|甲方代表{x}到场。|请找{x}办理交接。|据{x}口述，机器早已停转。|昨日{x}反映账号无法登录。|{x}已离职，钥匙未还。|收件人{x}不在。|经办：{x}|客户{x}来电。|与{x}确认过。|{x}老师签字。|请{x}经理审核。|姓名：{x}|投诉人{x}要求退款。",
        "Contact: {x}.|Signed for by Ms. {x}.|Signed for by {x}.|This slip was written by {x} alone.|The key is still with {x}, who left.|Please ask {x} for the handover.|According to {x} the fan had stopped.|{x} complained the same day.|Yesterday {x} could not log in.|Mr. {x} called twice.|Mrs. {x} paid.|Dr. {x} came.|Dear {x},|Name: {x}|Received by {x} on Monday.|The client, {x}, agreed.|I spoke with {x} today."),
}
MORE = {
    "email": (
        "有问题写邮件给{x}。|通知已抄送至{x}和总务科。|报名请联系{x}|账号{x}登录失败三次。|请加{x}为收件人。|自动回复来自{x}。|投稿邮箱为{x}（长期有效）。|她把合同传给了{x}，对方未回。|用户名 {x}|询价：{x}",
        "You can reach the team lead by mail ({x}).|A copy went to {x} as well.|Questions? {x}|Log in as {x} and reset it.|Add {x} to the list.|The bounce came from {x} at noon.|Sign up under {x}.|We wrote to {x}, but heard nothing.|From: {x}|His login was {x}.|forwarded by {x} on Monday"),
    "phone": (
        "有事打{x}。|请致电{x}预约。|联系方式 {x}（下班后勿扰）|司机号码{x}，到了会打。|留言请发{x}。|传真：{x}|{x} 这个号码打不通。|值班室{x}|如需帮助，拨{x}转人工。|我的号是{x}，随时打。|报修热线 {x}，24小时。",
        "Give me a ring on {x}.|You can text {x} any time.|Front desk: {x}.|My cell is {x}, call before nine.|Nobody answered at {x}.|{x} is the number of the night shift.|Leave a message at {x}.|WhatsApp {x}|mobile {x}|The new number, {x}, works.|Please phone {x} to book."),
    "id_number": (
        "请核对身份号码{x}。|居民身份证{x}，有效期十年。|乘机人证件：{x}|凭{x}领取。|他报的号码是{x}。|系统中登记为 {x}。|身份证后附：{x}。|证件：{x}，已扫描。",
        "SSN {x} is on file.|The applicant gave {x}.|ID: {x}|Please verify {x} first.|His number, {x}, was mistyped.|national ID {x}|The scan shows {x}.|Her tax form lists {x}."),
    "address": (
        "请到{x}面谈。|公司已迁至{x}。|回寄地址：{x}（到付拒收）。|现场位于{x}，进场要登记。|送货到{x}，电梯可用。|我住{x}。|发票寄{x}。|通讯地址 {x}|门牌为{x}，左手边。|事故发生在{x}门口。",
        "Please come to {x} for the interview.|We have moved to {x}.|Return address: {x}|Pick it up at {x}.|The site, {x}, is closed.|I live at {x}.|Invoices go to {x}.|mail it to {x} by Friday|The office at {x} opens at nine.|It happened outside {x}."),
    "name": (
        "今天由{x}值班。|感谢{x}的配合。|{x}说明天再来。|项目交给{x}负责。|我叫{x}。|已通知{x}本人。|{x}和同事一起到的。|经理{x}批准了。|请转告{x}。|申请人：{x}，已签字。|{x}（销售部）请假。|乘客{x}未登机。|是{x}发现的问题。|{x}上周调到了财务部。|新来的{x}还没有工牌。|这件事问{x}就行。|{x}的合同下月到期。|会上{x}提了三点意见。|{x}把样品带走了。|我和{x}一起去。|{x}，男，三十岁。|由{x}代为领取。|{x}同志请到前台。|报案人{x}称钥匙丢失。|请假人{x}，事由探亲。|{x}主任不同意。|昨天{x}打来电话。|{x}今天没有来。|给{x}发一份。|{x}负责排班。|{x}刚刚离开。|仓库交给{x}。|表扬{x}等三人。|{x}每天六点到。|找不到{x}。|{x}在现场。|让{x}先走。|值班：{x}。|主讲人{x}。|{x}写的报告很长。|车是{x}开的。|据说{x}要退休。|{x}笑着说没事。|{x}工程师验收。|护士{x}量了体温。|房东{x}涨了租金。|感谢同事{x}帮忙。|欢迎{x}加入。|祝贺{x}升职。|单号由{x}登记|{x}收|本人{x}，特此声明。|收货人为{x}，请当面点清。|委托{x}办理此事。|{x}反馈说屏幕不亮。|听{x}讲，机器坏了。|{x}已到岗。|经{x}确认无误。|签名：{x}|{x}、{x}",
        "My name is {x}.|{x} will cover the night shift.|Thanks to {x} for the help.|We met {x} at the fair.|Please tell {x} that it is ready.|The report by {x} is late.|{x} and a colleague arrived.|Approved by {x}.|{x} from the sales team is away.|Passenger {x} did not board.|I am {x}, the new tenant.|It was {x} who noticed.|Regards, {x}"),
}
# Never trained on: the held-out test's sentences.
HELD_OUT = {
    "email": (
        "麻烦把表格回传到{x}。|系统向{x}推送了提醒。|注册时填的是{x}，改不了。|原件扫描后寄{x}即可。|他惯用{x}收信。",
        "Kindly drop a note to {x}.|The newsletter goes out to {x} weekly.|Her recovery account is {x}.|Invoices bounce when sent to {x}.|You will find me under {x}."),
    "phone": (
        "晚上找我就拨{x}。|门卫的电话是{x}。|快递员留了{x}。|打{x}没人理。|客户回拨{x}两次。",
        "Try {x} if it is urgent.|The plumber left {x} on the door.|Her desk line, {x}, is busy.|Faxes go to {x}.|I keep calling {x} in vain."),
    "id_number": (
        "她的公民身份号码为{x}。|表里第三栏写着{x}。|复核{x}无误。|户口本上的{x}看不清。",
        "The licence was issued against {x}.|Column three holds {x}.|We matched {x} with the register.|Her passport file quotes {x}."),
    "address": (
        "新店开在{x}。|救护车开往{x}。|请把钥匙放到{x}。|租的房子在{x}，朝南。",
        "The ambulance went to {x}.|Our new shop is at {x}.|Leave the keys at {x}.|They rent {x} from an uncle."),
    "name": (
        "这批货归{x}管。|{x}昨晚加班到十点。|会议由{x}主持。|钥匙在{x}手里。|欢迎新同事{x}！",
        "The keys are with {x} now.|{x} chaired the meeting.|We welcome {x} to the team.|A call came in from {x} late.|Nobody but {x} knew."),
}
# Sentences without a mention that look like one; {d} stands for a digit, {u} for a word.
TRAPS = (
    "运单12{d}{d}{d}{d}{d}{d}{d}{d}{d}已签收。|流水号{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}已作废。|日志编号{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}。|物料编码{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}停用。|会议号{d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}。|号码已隐藏：138****{d}{d}{d}{d}。|净重1{d}{d}0.{d}{d}{d}{d}克，版本号2.13.{d}{d}{d}{d}。|见附件 notes@v{d}{d}{d}{d}。|测试环境地址为路由{d}{d}{d}{d}号口。|联系人信息见档案。|客户甲方代表到场。|住址栏为空。|特此说明。|以上内容供参考。|（修订稿）|【内部】|批号{d}{d}{d}{d}{d}{d}{d}{d}已入库。|订单{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}。|电话：137****{d}{d}{d}{d}。|身份证号：{d}{d}{d}{d}{d}{d}********{d}{d}{d}{d}。|联系人：无。|由女士专区签收。|先生产后销售。|高峰期暂停。|金额为{d}{d}{d}{d}{d}元。|方向盘已更换。|白天可接。|路由表已更新。|请找管理员办理交接。|据系统记录，机器早已停转。|昨日服务器反映账号无法登录。|这份单子是系统写的。|{b}|结果抄送{u}邮件组。|在{u}上线之后，|当{u}与{u}同时运行时，|经办：系统，复核人略。|{u}模块|# 总则 {u}\n|{u} 机密",
    "Waybill 12{d}{d}{d}{d}{d}{d}{d}{d}{d} was signed for.|Batch number {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} is void.|Log entry {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}.|Material {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} is retired.|Meeting code {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}.|The number is hidden: ***-***-{d}{d}{d}{d}.|See tag build@v{d}{d}{d}{d}.|Port {d}{d}{d}{d} on lane two stays shut.|The {u} Road project was renamed.|Ask the contact named in the file.|Home address left blank.|Internal note.|For reference only.|Draft.|(revised)|Release 2.13.{d}{d}{d}{d} weighs 1{d}{d}0.{d}{d} grams.|The {u} Lane pilot ended.|Phone: ***|Contact: none.|The key is still with the office.|Please ask the admin for the handover.|According to the log the fan had stopped.|The {u} branch complained the same day.|Yesterday the {u} gateway could not log in.|Signed for by the office.|The {u} access log and the {u} project group.|The {u} platform will forward it.|Order {d}{d}{d}-{d}{d}-{d}{d}{d}{d}{d} shipped.|{b}|{b} {b}|\n{u} Emergency Plan\n|\n{u} Operations Manual\n- {d}{d} -\n|\n{u} Service Policy\n|\n{u} Acceptance Rules  Edition {d}\n|\n{u} Maintenance Guide\n|# Overview {u}\n|and copy the result to {u}.|copy the result to {u}. |tell the {u} station. |at the cost of the {u} account.|After {u} goes live, |review the settings of {u}. |Total\n{d}{d}\n|| {u} | {d}{d}{d} |\n| {u} | {d}{d}{d}{d} ||{u} {w} {w} Confidential | {d}{d}|{u} {w} {w} Confidential | {d}\n- {d} -|\n{u} {w} {w}\n|\n{w} {w}\n|# {w} {w}|The {w} {w} was updated.|See {w} {w} for the steps.|{w} {u} is offline.|Copy the result to {u}. Compared with release {d},|copy the result to {u}. In most branches, |copy the result to {u}. Compared\nwith",
)
TRAPS = tuple(t.split("|") for t in TRAPS)
CARRIERS = {k: tuple(c.split("|") + m.split("|") for c, m in zip(v, MORE[k])) for k, v in CARRIERS.items()}
HELD_OUT = {k: tuple(c.split("|") for c in v) for k, v in HELD_OUT.items()}


class Maker:
    """Mentions and the sentences around them. ``background`` (by language) gives words and characters for
    streets, places and names, and stretches of text that stand around mentions without a frame."""

    def __init__(self, seed: int, background: dict[bool, list[str]] | None = None, frames: dict = CARRIERS):
        self.r = random.Random(seed)
        self.frames, self.background = frames, background
        held = background or {True: [], False: []}
        self.words = sorted({w.lower() for s in held[False][:4_000] for w in re.findall(r"[A-Za-z]{4,9}", s)}) or SYLLABLES
        self.chars = sorted({c for s in held[True][:4_000] for c in s if "一" <= c <= "鿿"}) or list(GIVEN)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(2, 3)))

    def invented(self) -> str:
        parts = "Ol Sor Pal Ve Wex Tho Mi Cor Lum Fen Ul Qui Zu Tri Ka Nor Bar Sel Ja Hy Rin Dro Ost Lo Mak Da Pra Vin Ge Tes".split()
        return "".join([self.r.choice(parts)] + [self.r.choice(parts).lower() for _ in range(self.r.randint(1, 2))])

    def email(self, han: bool) -> str:
        r = self.r
        user = r.choice([r.choice(FIRST).lower() + r.choice("._-") + r.choice(LAST).lower(), r.choice("abcdefghijklmnoprstw") + r.choice("._") + r.choice(LAST).lower(), r.choice(self.words) + self.digits(r.randint(1, 4)), self.word(), self.invented().lower(), self.word() + str(r.randint(1, 99)), self.word() + r.choice("._+-") + self.word(), self.invented() + "_" + self.invented(), self.word()[:2] + "_" + self.invented()])
        host = r.choice([r.choice(self.words) + r.choice(["", "-" + r.choice(self.words)]) + "." + r.choice(["com", "org", "net", "io", "co.uk", "de", "edu", "cn"]), self.word() + "." + r.choice(["com", "test", "example", "invalid", "org", "net", "cn", "com.cn"]), r.choice(["mail", "office", "post"]) + "." + self.word() + r.choice([".test", ".com", ".example"]), r.choice(["mail", "post"]) + r.choice([".example", ".invalid"])])
        form = r.random()
        if form < 0.55:
            return f"{user}@{host}"
        if form < 0.65:
            return f"{user} @ {host}"
        if form < 0.77:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        if form < 0.86:
            return f"{user}(at){host}"
        if form < 0.9:
            return f"{user} AT {host.replace('.', ' DOT ')}"
        return f"{user}@{host}".upper()

    def phone(self, han: bool) -> str:
        r = self.r
        if han or r.random() < 0.05:
            m = "1" + r.choice("3456789") + self.digits(9)
            return r.choice([m, m, m, f"{m[:3]}-{m[3:7]}-{m[7:]}", f"{m[:3]} {m[3:7]} {m[7:]}", f"{m[:3]}.{m[3:7]}.{m[7:]}", f"+86 {m}", f"+86{m}", f"0086{m}", f"0{r.randint(310, 999)}-{self.digits(7)}", f"(0{r.randint(20, 29)}){self.digits(8)}", f"0{r.randint(10, 29)}-{self.digits(8)}", "".join(DIGITS_ZH[int(c)] for c in m)])
        a, b, c = str(r.randint(200, 999)), str(r.randint(200, 999)), self.digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+44 20 {self.digits(4)} {self.digits(4)}", f"({a}) {b}-{c}", f"{a} {b} {c}"])

    def id_number(self, han: bool) -> str:
        r = self.r
        if not han and r.random() < 0.6:
            return f"{r.randint(900, 999) if r.random() < 0.7 else self.digits(3)}-{self.digits(2)}-{self.digits(4)}"
        s = f"{r.randint(1, 6)}{self.digits(5)}{r.randint(1940, 2006)}{r.randint(1, 12):02}{r.randint(1, 28):02}{self.digits(3)}"
        s += check_character(s)
        return r.choice([s, s, s, f"{s[:6]} {s[6:14]} {s[14:]}", f"{s[:6]}-{s[6:14]}-{s[14:]}"])

    def address(self, han: bool) -> str:
        r = self.r
        if han:
            place = lambda: "".join(r.choice(PLACE_ZH if r.random() < 0.6 else self.chars) for _ in range(2))
            city = r.choice(CITIES_ZH) if r.random() < 0.35 else place()
            s = r.choice(["", "", "", (r.choice(PROVINCES_ZH) if r.random() < 0.6 else place()) + "省"]) + city + "市" + r.choice(["", place() + "区", place() + "新区", place() + "县"])
            s += (r.choice(ROAD_WORDS_ZH) if r.random() < 0.5 else "".join(r.choice(self.chars) for _ in range(r.choice([2, 2, 3])))) + r.choice(ROADS_ZH) + f"{r.randint(1, 10 ** r.randint(1, 4) - 1)}号"
            return s + r.choice(["", "", f"{r.randint(1, 20)}栋{r.randint(101, 3204)}室", f"{place()[0]}园{r.randint(1, 12)}单元", f"{r.randint(1, 30)}号楼{r.randint(1, 9)}单元{r.randint(101, 999)}"])
        road = r.choice([self.word().capitalize(), f"Old {self.word().capitalize()}", f"{self.word().capitalize()} {r.choice(['Hill', 'Green', 'Park'])}", self.surname(), r.choice(self.words).capitalize(), f"{r.choice(self.words).capitalize()} {r.choice(['Grove', 'Park', 'Valley', 'Ridge', 'Lake', 'Mill', 'Oak', 'Bridge', r.choice(self.words).capitalize()])}", r.choice(LAST)])
        s = f"{r.randint(1, 10 ** r.randint(1, 4) - 1)} {road} {r.choice(ROADS_EN)}"
        if r.random() < 0.35:
            s += f", {r.choice(['Flat', 'Apt', 'Unit', 'Suite'])} {r.randint(1, 60)}"
        if r.random() < 0.7:
            s += ", " + self.surname() + (f" {self.word().capitalize()}" if r.random() < 0.2 else "")
            if r.random() < 0.5:
                s += f" {self.digits(5)}"
        return s

    def surname(self) -> str:
        return (self.r.choice(SYLLABLES) + self.r.choice(["", self.r.choice(SYLLABLES)]) + self.r.choice(ENDINGS)).capitalize()

    def name(self, han: bool) -> str:
        r = self.r
        if han:
            return r.choice(SURNAMES) + "".join(r.choice(GIVEN if r.random() < 0.7 else self.chars) for _ in range(r.choice([1, 2, 2])))
        if r.random() < 0.4:
            first, last = r.choice(FIRST), r.choice(LAST)
            return r.choice([f"{first} {last}"] * 5 + [f"{first} {r.choice('ABCDEFGHJKLMNPRSTW')}. {last}", f"{first[0]}. {last}"])
        first = r.choice([r.choice(FIRST), self.word()[:6].capitalize(), (r.choice(SYLLABLES) + r.choice(SYLLABLES)).capitalize()])
        last = self.surname()
        return r.choice([f"{first} {last}", f"{first} {last}", f"{last.upper()}, {first}", f"{first[0]}. {last}", f"{first[0]}. {last}", f"{first} {self.surname()[0]}. {last}", f"{first} {last}"])

    def sentence(self) -> tuple[str, list[tuple[int, int, str]], bool]:
        """A sentence with a mention or a trap, and its spans."""
        r = self.r
        han = r.random() < 0.5
        if r.random() < 0.3:
            s = r.choice(TRAPS[0 if han else 1])
            s = re.sub(r"\{d\}", lambda _: self.digits(1), s)
            s = s.replace("{b}", "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=") for _ in range(r.randint(20, 120))))
            s = re.sub(r"\{w\}", lambda _: r.choice(self.words).capitalize(), s)
            return re.sub(r"\{u\}", lambda _: r.choice([self.invented(), self.surname()]), s), [], han
        kind = r.choices(KINDS, (1, 1.2, 1, 1, 1.8))[0]
        mention = getattr(self, kind)(han)
        if r.random() < 0.12 and kind != "name":
            mention = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in mention)
        before, after, *more = r.choice(self.frames[kind][0 if han else 1]).split("{x}")
        if more:  # two of a kind
            other = getattr(self, kind)(han)
            a, b = len(before), len(before) + len(mention)
            at = b + len(after)
            return before + mention + after + other + more[0], [(a, b, kind), (at, at + len(other), kind)], han
        if self.background and r.random() < (0.06 if kind == "name" else 0.15):
            # No frame: the mention stands between two stretches of other text.
            cut = lambda t: t[: r.randrange(len(t) + 1)] if han else " ".join(t.split()[: r.randint(0, 8)])
            one, two = (cut(r.choice(self.background[han])) for _ in "ab")
            before, after = (one + r.choice(["，", "：", "（", "在", "到", "是", ""]), two) if han else (one + " " * bool(one), " " + two)
            if before and before[-1].isascii() and (before[-1].isalnum() or before[-1] in "-.+@"):
                before += " "
            if after and after[0].isascii() and (after[0].isalnum() or after[0] in "-.@"):
                after = "，" + after
        if not han and r.random() < 0.05:
            before, after = before.upper(), after.upper()
            mention = mention.upper() if kind in ("name", "address") and r.random() < 0.7 else mention
        return before + mention + after, [(len(before), len(before) + len(mention), kind)], han


def check_character(s: str) -> str:
    """The check character of the first 17 digits of an identity number."""
    return "10X98765432"[sum(int(c) * (1 << (17 - i)) for i, c in enumerate(s[:17])) % 11]


def batches(background: dict[bool, list[str]], size: int, length: int, seed: int):
    """Endless (texts, tags): made sentences between background sentences, cut to one length."""
    make = Maker(seed, background)
    r = make.r
    while True:
        texts, tags = [], []
        for _ in range(size):
            text, tag = "", []
            first = True
            while len(text) < length:
                if r.random() < 0.5:
                    s, spans, han = make.sentence()
                else:
                    han = r.random() < 0.5
                    s, spans = r.choice(background[han]), []
                    if not han and r.random() < 0.06:
                        s = s.upper()
                    if first and r.random() < 0.5:
                        s = s[r.randrange(len(s)) :]
                first = False
                glue = "" if r.random() < 0.5 and han else r.choice(["\n\n", "\n", " ", "  "]) if text else ""
                if text and not han and not glue:
                    glue = " "
                t = [0] * (len(glue) + len(s))
                for a, b, kind in spans:
                    k = 1 + 2 * KINDS.index(kind)
                    t[len(glue) + a] = k
                    for i in range(a + 1, b):
                        t[len(glue) + i] = k + 1
                text += glue + s
                tag += t
            texts.append(text[:length])
            tags.append(tag[:length])
        yield texts, np.array(tags)


def train(background: dict[bool, list[str]], seconds: float = 200, size: int = 96, length: int = 112, seed: int = 3, say=print, start: Tagger | None = None) -> Tagger:
    """Train for so many seconds, from ``start``'s weights where there is one (rows of common characters)."""
    make = batches(background, size, length, seed)
    counts: Counter = Counter()
    for _ in range(60):
        for t in next(make)[0]:
            counts.update(folded_codes(t).tolist())
    alphabet = "".join(sorted(chr(c) for c, n in counts.items() if (n >= 12 or c < 127) and 0 < c < 0x10000 and not 0xD800 <= c < 0xE000))
    tagger = Tagger(alphabet)
    if start is not None:
        old = {c: 4 + i for i, c in enumerate(start.alphabet)}
        for k, v in start.p.items():
            if k[0] != "x":
                tagger.p[k] = v.copy()
                continue
            tagger.p[k][:4] = v[:4]
            for i, c in enumerate(alphabet):
                tagger.p[k][4 + i] = v[old[c]] if c in old else v[2 if "一" <= c <= "鿿" else 1]
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.p.items()}
    han_ids = np.zeros(4 + len(alphabet), bool)
    han_ids[4:] = [0x4E00 <= ord(c) < 0xA000 for c in alphabet]
    began, step = time.time(), 0
    while (past := time.time() - began) < seconds:
        step += 1
        texts, tags = next(make)
        ids = np.stack([tagger.encode(t) for t in texts], axis=1)
        named = (tags.T == 1 + 2 * KINDS.index("name")) | (tags.T == 2 + 2 * KINDS.index("name"))
        hide = r.random(ids.shape) < np.where(named, 0.3, 0.04)  # unseen characters occur in names above all
        ids = np.where(hide & han_ids[ids], 2, ids)
        loss, g = tagger.loss_and_gradient(ids, tags.T)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.012 * max(0.03, 1 - past / seconds) * min(1.0, 8 / (norm + 1e-9))
        for k in tagger.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.995 * v[k] + 0.005 * g[k] * g[k]
            tagger.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-6)
        if step % 50 == 0:
            say(f"{past:.0f} s, step {step}: loss {loss:.3f}", flush=True)
    return tagger


def background_of(texts: list[str]) -> dict[bool, list[str]]:
    out: dict[bool, list[str]] = {True: [], False: []}
    for t in texts:
        for s in re.split(r"(?<=[。！？\n])|(?<=\. )", t):
            if len(s.strip()) > 3:
                out[bool(re.search(r"[一-鿿]", s))].append(s.strip())
    return {k: v[: BACKGROUND // 2] for k, v in out.items()}


def main(folder: str, seconds: float, again: bool) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    train(background_of(texts), seconds, start=Tagger.load() if again else None).save()


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 200, "again" in sys.argv[3:])
