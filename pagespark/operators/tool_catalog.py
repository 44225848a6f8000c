"""The tools that appear in call logs, and the rules their arguments must meet.

Both are fixed tables stated as text: one line per tool, one line per argument.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .rules import ROLES

# Tool names (the descriptions are ours).
TOOLS = """
browser_open          | open a URL in a new or given tab
browser_read          | page content as Markdown, text or HTML
browser_tabs_list     | open tabs, the active one marked
browser_tab_switch    | make a tab the active one
browser_tab_close     | close a tab
browser_click         | click an element
browser_type          | fill a field
browser_press         | press a key or chord
browser_hover         | move the pointer over an element
browser_select_option | choose options of a select element
browser_check         | set a checkbox or radio button
browser_drag          | drag one element onto another
browser_fill_form     | fill several fields at once
browser_scroll        | scroll the page
browser_back          | one step back in the history
browser_forward       | one step forward in the history
browser_reload        | reload the page
browser_find          | search the page text
browser_wait          | wait for an element or a condition
browser_evaluate      | evaluate an expression on the page
browser_open_visible  | open a visible window
browser_screenshot    | take a picture
browser_snapshot      | semantic tree of the page, or its changes
browser_expect        | check an assertion, with retries
browser_permissions   | grant or clear permissions
browser_save          | save the page to a file
browser_upload        | attach files to an input
browser_download_wait | trigger and save a download
browser_cookies       | read, set or clear cookies
browser_network_log   | recent requests
browser_console_log   | recent console messages
browser_network_body  | a recent response body
browser_storage       | local or session storage
browser_handle_dialog | how to answer dialogs
browser_set_geolocation | position of the device
browser_configure     | device, viewport, locale, headers
"""

# Argument rules. Columns: tools (comma list, without the common prefix), argument,
# type, then any of: required, min, max (numbers, or length of a string, or number of items),
# item (longest item of a list), in (allowed words), default.
ARGUMENTS = """
open,open_visible | url | url | required
read,find,wait,scroll,evaluate,back,forward,reload,click,type,press,hover,select_option,check,drag,fill_form,screenshot,snapshot,expect,permissions,save,upload,download_wait,open,storage,network_log,console_log,configure | tab_id | string |
tab_switch,tab_close | tab_id | string | required
read | mode | string | in=markdown,text,html default="markdown"
read,wait,screenshot,snapshot | selector | string | max=2048
read | max_chars | int | min=1
read,snapshot | compact | bool |
click,type,hover,select_option,check,drag,upload | target | string | required max=2048
press,expect,download_wait | target | string | max=2048
drag | source | string | required max=2048
click,type,press,hover,expect,download_wait | target_type | string | in=@locators default="text"
drag | source_type | string | in=@locators default="text"
drag | target_type | string | in=@locators default="text"
select_option,check | target_type | string | in=@locators default="label"
upload | target_type | string | in=selector,label,testid default="selector"
click,type,press,hover,select_option,check,expect,download_wait | role | string | in=@roles
drag | source_role | string | in=@roles
drag | target_role | string | in=@roles
click,type,press,hover,select_option,check,expect | exact | bool | default=false
type | text | string | required max=100000
type | submit | bool | default=false
press | key | string | required min=1 max=64
select_option | by | string | in=value,label,index default="value"
select_option | values | strings | required min=1 max=64 item=1024
check | checked | bool | default=true
fill_form | fields | objects | required min=1 max=64
fill_form | submit | bool_or_object |
scroll | direction | string | in=up,down,top,bottom default="down"
scroll | amount | int | min=1 default=800
find | query | string | required
find | limit | int | min=1 max=50 default=10
wait | condition | string | max=10000
wait | state | string | in=visible,hidden,attached,detached default="visible"
wait | timeout | int | min=1 default=10000
evaluate | expression | string | required max=10000
screenshot | full_page | bool | default=false
snapshot | max_depth | int | min=0 max=50
snapshot | interesting_only | bool | default=true
snapshot | store_as | string | min=1 max=64
snapshot | diff_against | string | min=1 max=64
snapshot | format | string | in=yaml,json default="yaml"
expect | assertion | string | required in=visible,hidden,enabled,disabled,text_equals,text_contains,text_matches,value_equals,count,url_matches,url_equals,title_matches,title_equals
expect | expected | text_or_number | max=4096
expect | timeout_ms | int | min=1 max=60000 default=5000
permissions | grant | grant | required max=32
permissions | origin | url |
save | format | string | required in=pdf,mhtml,html
save | path | string | required max=4096
save | full_page | bool | default=false
save | landscape | bool | default=false
upload | files | strings | required min=1 max=32 item=4096
download_wait | action | string | in=click,navigate default="click"
download_wait | url | url |
download_wait | save_to | string | required max=4096
download_wait | timeout_ms | int | min=1 max=600000 default=60000
cookies | action | string | required in=get,set,clear
cookies | urls | urls | max=32
cookies | cookies | objects | max=64
storage | action | string | required in=get,set,remove,clear
storage | area | string | in=local,session default="local"
storage | key | string | max=1024
storage | value | string | max=100000
network_log | limit | int | min=1 max=500 default=100
network_log,network_body | url_regex | string | max=512
network_log,network_body | method | string | in=GET,POST,PUT,DELETE,PATCH,OPTIONS,HEAD
network_log | failed_only | bool | default=false
network_log | min_status | int | min=100 max=599
console_log | level | string | in=log,info,warn,error,debug,pageerror
console_log | limit | int | min=1 max=500 default=100
console_log | text_regex | string | max=512
network_body | index | int | min=0 default=0
handle_dialog | action | string | in=accept,dismiss default="accept"
handle_dialog | prompt_text | string | max=4096
handle_dialog | persist | bool | default=false
set_geolocation | latitude | number | required min=-90 max=90
set_geolocation | longitude | number | required min=-180 max=180
set_geolocation | accuracy | number | min=0
configure | device_preset | string | in=iphone-15,iphone-se,ipad,ipad-pro,pixel-8,galaxy-s24,desktop-retina
configure | viewport_preset | string | in=mobile,tablet,desktop,desktop-hd,desktop-2k
configure | viewport_width | int | min=1
configure | viewport_height | int | min=1
configure | device_scale_factor | number | above=0
configure | is_mobile | bool |
configure | user_agent | string | max=512
configure | ua_preset | string | in=chrome-desktop,chrome-mobile,safari-desktop,safari-mobile,firefox-desktop
configure | locale | string | max=64
configure | color_scheme | string | in=light,dark,no-preference
configure | extra_headers | object | max=256 item=4096
"""

LOCATORS = ["text", "role", "label", "placeholder", "testid", "selector"]

RULE_TYPE = (
    "array<struct<arg:string,type:string,required:boolean,lo:double,hi:double,above:double,"
    "item:int,words:array<string>,fill:string>>"
)


@dataclass(frozen=True)
class ArgRule:
    arg: str
    type: str
    required: bool = False
    lo: float | None = None
    hi: float | None = None
    above: float | None = None
    item: int | None = None
    words: tuple[str, ...] | None = None
    fill: str | None = None

    def row(self) -> tuple:
        return (
            self.arg, self.type, self.required, self.lo, self.hi, self.above, self.item,
            list(self.words) if self.words else None, self.fill,
        )


def _rule(arg: str, kind: str, text: str) -> ArgRule:
    opts = dict(part.split("=", 1) if "=" in part else (part, "") for part in text.split())
    words = opts.get("in")
    named = {"@locators": LOCATORS, "@roles": ROLES}

    def num(key: str) -> float | None:
        return float(opts[key]) if key in opts else None

    return ArgRule(
        arg, kind, "required" in opts, num("min"), num("max"), num("above"),
        int(opts["item"]) if "item" in opts else None,
        tuple(named.get(words, words.split(","))) if words else None,
        opts.get("default"),
    )


def argument_rules() -> dict[str, list[ArgRule]]:
    rules: dict[str, list[ArgRule]] = {name: [] for name, _ in tool_rows()}
    for line in ARGUMENTS.strip().splitlines():
        tools, arg, kind, text = (part.strip() for part in line.split("|", 3))
        for tool in tools.split(","):
            rules[f"browser_{tool.strip()}"].append(_rule(arg, kind, text))
    return rules


def tool_rows() -> list[tuple[str, str]]:
    return [tuple(p.strip() for p in line.split("|")) for line in TOOLS.strip().splitlines()]


def tools_table(spark: SparkSession) -> DataFrame:
    """Tool catalogue: name, description."""
    return spark.createDataFrame(tool_rows(), "name string, description string")


def rules_table(spark: SparkSession) -> DataFrame:
    """One row per tool with its argument rules (a fixed few dozen rows, safe to broadcast)."""
    data = [(tool, [r.row() for r in rules]) for tool, rules in argument_rules().items()]
    return spark.createDataFrame(data, f"name string, rules {RULE_TYPE}")
