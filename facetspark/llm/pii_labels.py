"""The small labelled table from which the field is trained: sentences with invented mentions.

Every row is (text, mentions), a mention being (kind, start, end). Slots of the sentences are filled by a seeded
generator from common names and places of several countries, half of them blended into words that no list holds, so
that the field must go by shape and surroundings. Words and phrases of lines without a mention come from a public
vocabulary. No sentence is copied from the tables that are searched, but kinds of lines were added after looking at
what went wrong on the smaller test documents; the README says how, and what unseen rows give.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "idnum", "address", "person")

#: Sentences, one a line; p, e, t, i, a stand for person, email, phone, identity number, address; # for a digit, w for
#: a common word, n for a common word in code, T for some words in title case, c for a town; v, V
#: and M for made-up words in lower, title and mixed case, W for a word in capitals.
SENTENCES = r"""
Written by {p} <{e}> in the spring.
Notebook by {p}, mail to {e} with corrections
# maintained by {p} ({e})
## {p} <{e}>
# FIXME: {p} wants this {n} renamed, phone {t}
# see {p} or mail {e} before touching the {w}
Helpdesk {t}, otherwise {p} at {e}.
For {w} and {w} ring {t} or drop a line to {e}.
Please send changes of the {w} to {e}.
Please talk to {p} ({e}) first.
(thanks, {p})
[warning] mail to {e} bounced
admin = '{e}'
CONTACT = "{e}"  # {p}
ADMINS = ['{e}', "{e}"]
Patient {p}, passport {i}, of {a}, can be called on {t}.
Case file: {p}, id {i}, resident at {a}, mobile {t}
customer = {'full_name': '{p}', 'ssn': '{i}', 'email': '{e}'}
{"customer": "{p}", "tel": "{t}", "street": "{a}"}
{"owner": "{p}", "addr": "{a}", "tel": "{t}", "n": ##}
{'id': '{i}', 'owner': '{p}', 'mail': '{e}', 'n': #.##}
{"user": "{p}", "contact": "{e}"}
##  {p}  {t}  ##.#
#   {p}    {e}    ###.##
#     {p}      {i}      #.#
{p}   {e}   #.#
{p}, {t}, ##.#
{p},{e},####-##-##
{p};{t};{c}
| {p} | {e} | {t} |
<td>{p}</td><td>{t}</td>
name,mail\n{p},{e}
name   phone\n{p}   {t}\n{p}   {t}
Checked by {p} ({i})
Approved: {p}, {i}
Signed, {p}
Dear {p},
Best wishes\n{p}
LookupError: '{i}'
ValueError: bad token '{t}' in row ##
TypeError: cannot parse '{i}'
KeyError: '{e}'
record {i} of {p} is broken
drop = people[people.phone == '{t}'].index
people = people[people.email != '{e}']
people.loc[people['tel'] == '{t}', 'ok'] = False
mask = people['passport'] == '{i}'
send_mail(['{e}', '{e}'], title='{w} report')
requests.get('https://{n}.example.org/join?user={e}&lang=en')
See https://{n}.example.com/?to={e} for the {w}.
The samples were collected by {p} near {a} last {w}.
We are grateful to Dr. {p} and Mrs {p} for the {w}.
Thanks go to Prof. {p}, {p} and {p}.
The instrument was lent by Dr {p} of {c}.
Return the {w} to {a}.
Ship everything to {a}.
Our postal address: {a}
Office:\n{a}
Mailing address\n{a}
Deliver to\n{a}\nbefore noon
address = "{a}"
to = '''{a}'''
label = \"\"\"{a}\"\"\"
print(\"\"\"{a}\"\"\")
Id number {i} is that of {p}, who lives at {a}.
National number {i}, issued to {p}.
Licence {i}; holder {p}
{p} (tel. {t})
{p} - {t}
Call {p}, {t}.
{p} said the {w} was late, and {p} agreed.
According to {p}, the {w} in {c} is older than the {w}.
My name is {p} and I study {w}.
As {p} showed, {w} and {w} differ.
Autorin: {p}, E-Mail {e}
Kontakt: {p}, Telefon {t}
Bei Fragen wenden Sie sich an {p} oder {e}.
Die Messung hat {p} in {c} gemacht, Anschrift {a}.
Frau {p} wohnt in {a}.
Der Antrag von {p}, Pass {i}, liegt vor.
Personalausweis {i} von {p}
Wir danken Herrn {p} für die {T}.
Bitte rufen Sie {t} an.
Bitte {V} nur an {e} senden.
{V} und {V} bitte an {e}
Autor: {p}, correo {e}
Preguntas a {p}, tel. {t}.
La muestra la trajo {p}, con domicilio en {a}.
El documento {i} pertenece a {p}.
Documento de identidad {i} del paciente {p}
Escriba a {e} o llame al {t}.
Doña {p} vive en {a}.
Gracias a {p} por los datos de {c}.
Auteur : {p}, courriel {e}
Merci de contacter {p} au {t}.
Adresse : {a}
Madame {p} habite {a}.
作者：{p}，邮箱 {e}
请联系{p}，手机 {t}。
请与 {p} 联系：{e}
身份证号码 {i}，姓名 {p}。
数据由{p}整理，住址：{a}。
{p} 的地址是{a}，电话 {t}。
感谢 {p} 和 {p} 提供数据。
发送邮件至 {e} 获取帮助
护照 {i}，持有人 {p}
{e}
{t}
{a}
{i} {p}
tel {t}
ID: {i}
mail: {e}
name: {p}
{T}. {p} wrote the {w}.
The {w} is slow because of the {w}. Ask {p} ({i}).
The {w} of {T} was given to {p}.
(a {w} for {p})
(write to {p})
({w} by {p})
{w} {w} for {p}, {w} {w} from {p}
a gift of {p} to {p}
with {p} and without {p}
{w} {w} {w}, {p}, {w} {w} {w}
We load {n} and fill gaps with zero. Mail {e} if the {w} breaks.
First we merge {n} with {n}, see the remarks of {p} ({e}). Then we plot.
A short look at {n}: the mean is #.##. Visitors should call {t} or see {p}.
"""

#: Lines without a mention, many of them shaped like one.
PLAIN = r"""
# {T}
## {T}
### {T}
**{T}** and *{T}*
*{T}* is a {w}, {T} another one.
- {T}
{T}: {w} and {w}
{T}
{T} is a film; {T} is a book.
The song {T} was first played in {c}.
In {c} the {w} of the {w} had a {w} for the {w}.
We follow {T} (####) and use the {w} of {T}.
The {w} near {c} holds ## {w} and # {w}.
{w} {w} {w} {w} {w} {w}.
{W} {W} {W} {W} {W} {W}.
{W} {W} {W} {W} ## {W} {W}
the {w} in {c} Bay had {w} ### {w}
North {c} and South {c} share a {w}.
Question: how many {w} did the {w} of {c} keep if ## were lost?
Random Forest, Gradient Boosting and Naive Bayes are compared.
from sklearn.linear_model import Ridge, Lasso
from {n}.{n} import {n}
import {n} as {n}
class {T1}{T1}(BaseModel):
def {n}_{n}({n}, {n}=###):
    return {n} @ {n}.T + {n}[#]
@{n}.{n}
@pytest.fixture
x @ y
{n} = {n} @ {n}
git clone git@github.com:{n}/{n}.git
ssh {n}@localhost -p ####
scp {n}@{n}:/data/{n} .
pip install {n}==#.#.# {n}>=##.#
acc@#: #.###   map@##: #.###
{n}.plot(x='{n}', y='{n}', figsize=(#, ##))
{n} = {n}[{n}['{n}'] > ###]
{n}['{n}'] = {n}['{n}'].fillna(#.#)
assert {n}.shape == (####, ##), '{n}'
print(f'{n}: {{n}:.#f}')
File "/usr/lib/python#.##/site-packages/{n}/{n}.py", line ###, in {n}
/opt/{n}/{n}.py:##: UserWarning: {w} {w} {w}
Traceback (most recent call last):
KeyError: '{n}'
ValueError: {w} {w} '{n}'
[#.####, -#.####, #.####, #.####, -#.###, #.###]
array([[ #.#####,  -#.#####], [#.#####, #.#####]])
tensor(#.####, grad_fn=<{T1}Backward0>)
[########, #########, ##########]
[ ####, #####, ######, ####### ]
#.######e-## #.######e+##
-##.###### ###.###### -###.##
#.#####################
####-##-## ##:##:##
####-##-##T##:##:##Z {n} ok
## {T1} #### ##:##
##/##/#### ##.##.####
##:##:##.###
{n}   ###.##   ok
###   ##.#   {n}   NaN
#     {n}     ####.##     {n}
count   ####.######
mean    ##.######
epoch ##/### - loss: #.#### - {n}: #.####
step #### {n} #.##e-##
 ##%|████      | ##/### [##:##<##:##,  #.##it/s]
Wall time: #.## s
CPU times: user ### ms, sys: ## ms
###.###.###.### - "GET /{n} HTTP/#.#" ###
10.#.##.### 192.168.#.##
commit #a##f##c##d##e##b#
md5 ##c#d##ab##f####e#
uuid ########-####-####-####-############
run ##################
run ################
job ############ finished
build #########
order ########## of {T}
ISBN ###-#-####-####-#
doi 10.####/{n}.####.#####
arXiv:####.#####
version ##.##.#-###
part {W1}-####-##
{w} code ###-##-##, {w} code ##-####
stock no. ##-###-## or {W1} ## ##
serial numbers ###-##-## and ###-##-##
items such as ##-##-## and ###-##-##
Room ##, Building #
Section ##, page ###
Chapter #: {T}
Table ##: {T}
Figure #. {T}
Fig. # {T}, left
Exercise #: {w} the {w} of {n}
lat ##.######, lon -###.######
EPSG:####
{n} = ##########
seed = ########
{n}_id: ###########
<tr><td>###</td><td>#.###</td><td>{n}</td></tr>
<div class="{n}">{T}</div>
<th>{n}</th><th>{n}</th>
data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAA
{n},{n},{n}
#,###.##,{n},####
SELECT {n}, COUNT(*) FROM {n} GROUP BY {n}
library(ggplot2)
{n} <- read.csv('{n}/{n}.csv')
using {T1}, {T1}
$$ {n} = \frac{#}{#} \sum_i x_i $$
Das {T1} der {T1} liegt bei ##,#.
Wir entfernen die {T1} und prüfen die {T1} {T1}.
Die {T1} zeigt im Sommer mehr {T1} als im Winter.
Im zweiten Teil wird das {T1} Modell geprüft.
Los datos de {n} se leen del {w} y la columna tiene ## {w}.
Quitamos ## filas y el modelo queda en #.##.
La gráfica de {n} muestra el invierno.
On charge les données de {n} puis on trace la courbe.
先读取数据，再计算每月的平均值。
下面的图显示夏天的数值更高，共 ### 行。
练习：用 ## 天的窗口重新计算 {n}。
这个模型用了 ### 个样本，结果不稳定。
我们删除空行并合并两张表。
In [##]:
Out[##]:
{w} {v} {w} {w} {v} {w}.
{v} {v} {w} {v}
we {w} {v} {w} to {v} {w} and {w} the {v}
Now {v} the {w} with {v} {w}, then {w} {v}.
The {v} {v} of the {w} {v} is {w}.
what an {v} {v} must {w} next
- {v} {w} {v} {w}
return {v}.{v}({v}=#)
{v} = {v}.{v}({v}, {v}=#.#)
plot({v}.{v}, {v}.{v}, lw=#)
{v}.{v}.{v}({n})[{n}]
def {v}_{w}({v}, {n}=#):
if {v}.{w} > ##: {v}.{v}()
for {v} in {v}({n}):
using {T1}{T1}, {M}
import {M}, {M}
{M} and {M} are {T1}{T1}s
{T1}{T1}({M}, {M})
Das {V} ist noch sehr {v}.
Bitte prüfen Sie das {V} und die {V}.
Lösen Sie die Aufgabe und vergleichen Sie die {V}.
Berechnen Sie den {V} der {V} mit einem {V} von ## Tagen.
Der Fehler liegt im {V}, nicht im {V}.
Es gibt ## leere Zeilen in der Spalte {n}.
Danach werden {V} und {V} verglichen, wie oben gezeigt.
Das Bild zeigt im Winter deutlich höhere Werte.
Zuerst lesen wir die Datei {n} ein.
Hinweis: Das Ergebnis ist noch nicht endgültig.
Cada grupo tiene {v} {v} y la media es #.#.
Calcule la {v} con una ventana de ## {v}.
El resultado no está {v} todavía, falta {v} el modelo.
La tabla muestra {v} {v} en verano y {v} en otoño.
Ejercicio: repita la {v} y compare los {v}.
Primero leemos el archivo {n} y vemos las columnas.
Se borran las filas {v} antes de {v}.
La courbe montre des {v} plus {v} en hiver.
Le modèle n'est pas encore {v}, il faut {v} les {v}.
Exercice : refaire le {v} avec ## {v}.
De tabel laat zien dat {v} {v} hoger zijn.
数据来自公开网站，共有 ## 列。
把缺失值填成零以后再画图。
本节介绍如何清洗数据和调整参数。
冬天的温度明显更低，请看下图。
先按月份分组，再求中位数。
结果保存到文件，方便以后使用。
地址列为空，电话列也为空。
姓名一列共有 ## 个空值。
载入 {w} {w} 表后核对 {n} 列并排序。
用 {n} 函数计算并返回 {n} 值。
请安装 {n} 包，再运行 {n} 单元并查看结果。
打印 {w} 的前 ## 行，同时检索 {n} 字段。
把 {w} {w} 文件合并起来，转换 {n} 格式。
kept # ### ### {w}, lost ## ### of # ### ### ###
{n}: # ### ### ###
read ## ### ### {w} in # ### s
#,###,### of ##,###,### {w}
total # ### ### ### {w}
{w} left: ## ### ### of # ### ### ###
{n} = # ### ###
in all # ### ### ### of ## ### ### ###
# ### ### ###
{w} # ### ###, {w} # ### ### ###
{c} Regis had ## {w} and {c} Parva none.
the {w} at {c} Heath, once the {v} had {w}
{W} {w} {W} {W}: {W} {W}, {W} {W}
THE {W} {W} IN {W} HAD ## {W}
# %% [{n}]
```{n}
```
"""

_GIVEN = (
    "Anna Maria Peter John James Robert Michael Linda David Susan Thomas Karen Daniel Laura Emily George Alice Henry Clara Oscar Hugo Emma Louis Chloé Lucas Camille Pierre Jeanne Antoine Élodie "
    "Hans Petra Jürgen Ute Klaus Sabine Günter Heike Matthias Anja Björn Astrid Lars Ingrid Søren Kirsten Nils Freja Pekka Aino Marta Piotr Agnieszka Tomasz Katarzyna Jakub Zuzanna Jiří Věra Pavel "
    "Ivan Olga Dmitri Natalia Sergei Irina Giulia Marco Francesca Paolo Chiara Carlos Lucía José Carmen Javier Pilar Diego Inés João Beatriz Tiago Luísa Mehmet Ayşe Emre Fatma Yusuf Leila Omar Aisha "
    "Rajesh Priya Arjun Deepa Wei Ling Kenji Yuki Haruto Sakura Minh Linh Nguyet Siobhán Declan Aoife Gareth Rhiannon Owen Fiona Hamish Benedict Rosalind Cornelius Henrike Ottilie Aurelia Casimir"
).split()
_FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thompson Harrison Whitfield Ashworth Pemberton Fairbanks Holloway Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann "
    "Zimmermann Krüger Lindqvist Johansson Andersson Eriksen Nielsen Sørensen Bergström Haugen Virtanen Korhonen Kowalski Wiśniewski Nowak Zieliński Novák Svoboda Dvořák Horváth Szabó Popescu Ivanov "
    "Petrov Volkov Sokolov Rossi Ferrari Bianchi Esposito Moretti Lombardi García Martínez López Sánchez Fernández Navarro Herrera Silva Santos Ferreira Oliveira Almeida Dubois Lefèvre Moreau Girard "
    "Rousseau Yılmaz Demir Kaya Hassan Rahman Iqbal Sharma Patel Gupta Banerjee Tanaka Suzuki Watanabe Nakamura Nguyen Tran Pham Kim Park Lee Chen Wang Okafor Mensah Diallo Murphy Gallagher McKenzie Campbell"
).split()
_PARTICLES = ["van der", "von", "de", "de la", "van", "da", "di", "del"]
#: Family names: the frequent ones, and those of two signs.
_ZH_FAMILY = (
    "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 高 林 郑 罗 梁 宋 谢 唐 韩 曹 许 邓 冯 "
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 申屠 公孙 慕容 钟离 长孙 宇文 司徒 司空 令狐 百里 呼延 东郭"
).split()
_ZH_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红志建国文斌云飞雪梅晨宇佳琪思远浩然梓涵子轩若曦怀瑾承志清越春秋雨风山海月星松竹青岚舟川林江溪望听落微知景行安宁乐康"
_TOWNS = (
    "London Leeds Bristol Norwich Exeter Dundee Cardiff Belfast Chicago Boston Denver Portland Phoenix Houston Berlin Hamburg München Leipzig Dresden Köln Freiburg Madrid Sevilla Granada Bilbao Zaragoza "
    "Paris Lyon Nantes Toulouse Lille Vienna Graz Zürich Basel Oslo Bergen Göteborg Malmö Aarhus Helsinki Kraków Gdańsk Brno Porto Lisboa Torino Bologna Ottawa Toronto Sydney Perth Auckland Dublin Galway"
).split()
_STREETS = "High Church Station Victoria Park London Mill School Manor Albert North Queen's King's Maple Oak Cedar Elm Washington Lake Sunset Chestnut St. John's Walnut River Spring|Garden Old|Post West|End Bishop's Upper|Bridge".replace("St. ", "St.|").split()
_KINDS_OF = "Street Street St St. Road Road Rd Rd. Lane Ln Avenue Ave Ave. Drive Dr Close Court Ct Way Place Terrace Crescent Square Gardens Boulevard Blvd".split()
_DE = "Hauptstraße|Bahnhofstr.|Goethestraße|Schillerplatz|Ringstraße|Am Markt|Kirchweg|Lange Gasse|Ludwig-Erhard-Allee|Dorfstr.|Unter den Eichen|Am Alten Bahnhof|In der Au|Parkallee|Wiesenweg|Zur Linde|Marktplatz|Hinter dem Turm|Käthe-Kollwitz-Straße|Steinweg".split("|")
_ES = "Calle de Alcalá|Calle Real|C/ Serrano|Avda. de la Constitución|Avenida de América|Plaza de España|Paseo de Gracia|Camino Viejo|Calle del Carmen|C/ San Juan|Ronda de Toledo|Travesía del Río|Plaza del Pan|Paseo del Prado".split("|")
_FR = "rue de Rivoli|rue Victor Hugo|avenue Jean Jaurès|boulevard Saint-Michel|place de la République|rue des Lilas|chemin du Moulin|quai de la Loire".split("|")
_ZH_TOWN = "北京市 上海市 广州市 深圳市 杭州市 成都市 南京市 武汉市 苏州市 大理市 朝阳区 浦东新区 天河区 安吉县 桐庐县".split()
_ZH_STREET = "人民路 中山路 解放大道 建国门外大街 和平街 南京东路 长安街 文化巷 学院路 新华街 滨江大道 东风路 梅花巷 石板街 青年路".split()
_STATES = "AL AK AZ CA CO CT FL GA HI ID IL IN KS KY LA MA MD ME MI MN MO MT NC NE NJ NM NV NY OH OK OR PA RI TN TX UT VA VT WA WI".split()
#: Used where no vocabulary is given.
FEW_WORDS = "table river simple quiet window number yellow market stone winter column value random garden report hollow little bridge music paper signal model early travel".split()


class _Maker:
    def __init__(self, seed: int, words: list[str]):
        self.r, self.words = random.Random(seed), words or FEW_WORDS

    def one(self, items):
        return items[int(self.r.random() * len(items))]

    def d(self, shape: str) -> str:
        return re.sub("#", lambda _: self.one("0123456789"), shape)

    def blend(self, names: list[str]) -> str:
        """A name of the list, or as often the head of one and the tail of another."""
        a = self.one(names)
        if self.r.random() < 0.45 or len(a) < 4:
            return a
        b = self.one(names)
        return a[: self.r.randint(2, min(5, len(a) - 1))] + b[-self.r.randint(3, 6) :].lower()

    def family(self) -> str:
        f, x = self.blend(_FAMILY), self.r.random()
        return f"O'{f}" if x < 0.04 else f"{f}-{self.blend(_FAMILY)}" if x < 0.09 else f"{self.one(_PARTICLES)} {f}" if x < 0.14 else f

    def p(self) -> str:
        if self.r.random() < 0.13:
            given = self.one(_ZH_GIVEN) + self.one(["", self.one(_ZH_GIVEN)])
            return self.one(_ZH_FAMILY) + given
        g, f, m = self.blend(_GIVEN), self.family(), self.one("ABCDEFGHIJKLMNOPQRSTUVWXYZÉØ") + "."
        x = self.r.random()
        s = f"{m} {f}" if x < 0.12 else f"{f}, {g}" if x < 0.26 else f"{f}, {m}" if x < 0.29 else f"{g} {m} {f}" if x < 0.4 else f"{g} {self.blend(_GIVEN)} {f}" if x < 0.44 else f"{g} {f}"
        x = self.r.random()
        return s.upper() if x < 0.1 else s.lower() if x < 0.2 else s

    def e(self) -> str:
        g, f = self.blend(_GIVEN).lower(), self.blend(_FAMILY).lower()
        local = self.one([f"{g}.{f}", f"{g}.{f}+{self.one(self.words)}", f"{f}_{g}", f"{g[0]}-{f}", f"{g[0]}{f}", f"{g}{self.d('##')}", f"{f}.{g}", g, f"{g}_{self.d('####')}", self.one(["info", "help", "office", "team"])])
        local = re.sub(r"[^a-z0-9._+-]", "o", local)
        host = [*self.one([[], [], ["mail"], ["cs"], ["eng"], ["uni"], ["lists"]]), re.sub(r"[^a-z-]", "", (self.blend(_TOWNS) + self.one(["", "", "-" + self.one(self.words), "soft", "net"])).lower()), self.one(["com", "org", "net", "edu", "de", "es", "co", "example", "test", "invalid", "local"])]
        x = self.r.random()
        if x < 0.11:
            return f"{local} (at) {' (dot) '.join(host)}"
        if x < 0.15:
            return f"{local} [at] {' [dot] '.join(host)}"
        if x < 0.16:
            return f"{local} at {' dot '.join(host)}"
        at = " [at] " if x < 0.2 else "%40" if x < 0.27 else " @ " if x < 0.33 else "&#64;" if x < 0.36 else "[at]" if x < 0.38 else "(at)" if x < 0.4 else "@"
        out = local + at + ".".join(host)
        y = self.r.random()
        return out.upper() if y < 0.07 and at == "@" else out.title() if y < 0.2 and at == "@" else out

    def t(self) -> str:
        forms = "+44 ### ### ####|+44 #### ######|+44 (0)## #### ####|0#### ######|0#### ### ###|020 #### ####|(0##) #### ####|(0###) ### ####|0044 #### ### ###|+1 ### ### ####|+1 (###) ###-####|+1-###-###-####|+1##########|(###) ###-####|(###) ### ####|###-###-####|###.###.####|### ### ####|+49 ## #######|+49 (0)## ##### ###|+49 ### #######|0## #######|0##/######|0### ######|+33 # ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|+34 ### ### ###|### ## ## ##|+34 ### ## ## ##|+86 1## #### ####|1##########|1## #### ####|+61 ### ### ###|+61 # #### ####|+91 ##### #####|+81 ## #### ####|+46 ##-### ## ##|+48 ### ### ###|+7 ### ###-##-##|+39 ## #### ####"
        return self.d(self.one(forms.split("|")))

    def i(self) -> str:
        upper = lambda n: "".join(self.one("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        x = self.r.random()
        if x < 0.25:
            return self.d(self.one(["###-##-####", "### ## ####"]))
        if x < 0.5:
            return upper(2) + self.d(self.one([" ## ## ## ", "######", " ###### "])) + self.one("ABCD")
        if x < 0.7:
            return upper(self.one([1, 2])) + self.d(self.one(["#######", "######", "########"]))
        if x < 0.85:
            return self.d("######") + self.one(["19", "20"]) + self.d("##") + self.one(["0", "1"]) + self.d("#") + self.one("012") + self.d("#") + self.d("###") + self.one([self.d("#"), self.d("#"), "X"])
        return self.d("########") + self.one(["", "", "-", " "]) + self.one("ABCDEFGHJKLMNPQRSTVWXYZ")

    def street(self) -> str:
        s = self.one(_STREETS).replace("|", " ") if self.r.random() < 0.5 else self.blend(_TOWNS) if self.r.random() < 0.6 else self.one(self.words).title() + self.one(["", " " + self.one(self.words).title()])
        return f"{s} {self.one(_KINDS_OF)}"

    def a(self) -> str:
        x, town, n = self.r.random(), self.blend(_TOWNS) + self.one(["", "", "", "", " Regis", " Parva", " Heath", " Spa"]), f"{self.r.randint(1, 260)}"
        gap = "\n" if self.r.random() < 0.4 else ", "
        if x < 0.17:
            return f"{self.one(_DE)} {n}{self.one(['', '', '', 'a', 'b', 'c'])}{gap}{self.d('#####')} {town}"
        if x < 0.32:
            within = "\n" if gap == "\n" and self.r.random() < 0.5 else ", "
            return f"{self.one(_ES)}{self.one([within, within, ' '])}{n}{within}{self.one(['2.º A', '1.º dcha.', 'bajo', '4.º izq.', 'ático', '3º B', 'local 2'])}{gap}{self.d('#####')} {town}"
        if x < 0.37:
            return f"{n}{self.one(['', ' bis', ''])}{self.one([', ', ' '])}{self.one(_FR)}{gap}{self.d('75###')} {town}"
        if x < 0.5:
            return f"{self.one(_ZH_TOWN)}{self.one(['', '', self.one(_ZH_TOWN)])}{self.one(_ZH_STREET)}{n}号{self.d(self.one(['', '', '#单元#0#室', '#栋', '1#栋', '#号楼', '1#号楼', '#单元1#0#室', '#楼']))}"
        flat = self.one(["", "", "", "", f"Flat {self.r.randint(1, 40)}{gap}", f"Unit {self.r.randint(1, 40)}{gap}", f"Apartment {self.r.randint(1, 40)}{gap}"])
        line = f"{flat}{n}{self.one(['', '', '', '', 'a', 'B'])} {self.street()}{self.one(['', '', '', f' Apt {self.r.randint(1, 9)}{self.one("ABCD")}', f', Apt {self.r.randint(1, 99)}', f' #{self.r.randint(1, 99)}'])}"
        letters = lambda k: "".join(self.one("ABCDEFGHJKLMNOPQRSTUVWXYZ") for _ in range(k))
        y = self.r.random()
        if y < 0.4:  # as in the United Kingdom
            code = letters(self.one([1, 2])) + self.d(self.one(["#", "##"])) + self.one(["", "", letters(1)]) + " " + self.d("#") + letters(2)
            return f"{line}{gap}{town}{self.one([' ', ' ', gap])}{code}"
        if y < 0.8:  # as in the United States
            return f"{line}{gap}{town}{self.one([', ', gap])}{self.one(_STATES) if self.r.random() < 0.5 else letters(2)} {self.d(self.one(['#####', '#####', '#####-####']))}"
        return f"{line}{gap}{town}"

    def c(self) -> str:
        return self.blend(_TOWNS)

    def w(self) -> str:
        return self.one(self.words)

    def n(self) -> str:
        return self.one(["df", "x", "y", "model", "data", self.w(), f"{self.w()}_{self.w()}"])

    def v(self) -> str:
        """A word that no list holds."""
        a, b = self.w(), self.w()
        return a if self.r.random() < 0.3 else a[: self.r.randint(2, 5)] + b[-self.r.randint(2, 5) :]

    def V(self) -> str:
        return (self.v() + self.one(["", "ung", "keit", "en", self.w()])).title()

    def M(self) -> str:
        return self.one([self.v().upper(), self.v().title() + self.v().title(), self.w()[:3].upper()])

    def T(self) -> str:
        s = " ".join(self.w().title() for _ in range(self.one([1, 2, 2, 2, 3, 4])))
        return s.upper() if self.r.random() < 0.15 else s


def labelled_rows(n: int = 6000, seed: int = 11, words: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` rows, more than a third of them without a mention; words: common words to write with."""
    m = _Maker(seed, words or [])
    sentences, plain = ([s.replace("\\n", "\n").replace('\\"', '"') for s in t.strip("\n").split("\n")] for t in (SENTENCES, PLAIN))
    slot = re.compile(r"\{([petiawncTvVM])\}|\{(T1|W1|W)\}|#+")
    kinds = dict(zip("etiap", KINDS))
    out = []
    for k in range(n):
        form, text, marks, last = m.one(plain if k % 5 in (1, 3) else sentences), "", [], 0
        if k % 5 == 1 and k % 2:
            form = f"{form}\n{m.one(plain)}"
        shout = k % 5 in (1, 3) and m.r.random() < 0.1
        comment = re.match(r"#+ [^#]", form)
        for s in slot.finditer(form):
            text += form[last : s.start()]
            last, name, other = s.end(), s.group(1), s.group(2)
            if name is None and other is None:
                text += s.group() if comment and not s.start() else m.d(s.group())
            elif other:
                text += m.w().upper() if other[0] == "W" else m.w().title()
            elif name in kinds:
                value = getattr(m, name)()
                marks.append((kinds[name], len(text), len(text) + len(value)))
                text += value
            else:
                text += getattr(m, name)()
        text += form[last:]
        text = text.upper() if shout and len(text.upper()) == len(text) else text
        if "\n" in text and m.r.random() < 0.6:  # an address among other lines
            above, below = (m.one(["import os", "", "x = 1", "```", f"{m.w()} {m.w()}", f"# {m.T()}", f"{m.n()} = {m.d('##')}"]) for _ in range(2))
            marks = [(kind, a + len(above) + 1, b + len(above) + 1) for kind, a, b in marks]
            text = f"{above}\n{text}\n{below}"
        out.append((text, marks))
    return out
