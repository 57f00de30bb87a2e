"""URLs and methods of a small project."""

from flowloom.sources import django, files

SOURCES = {
    "site/urls.py": """
from django.urls import include, path
from shop import views as v
urlpatterns = [
    path('', v.home),
    path('shop/', include('shop.urls')),
    path('shop/', v.late),
]
""",
    "shop/urls.py": """
from django.urls import include, path
from rest_framework.routers import DefaultRouter
from . import views
from .views import Listing
router = DefaultRouter()
router.register('items', views.ItemSet)
router.register(prefix=r'notes', viewset=views.NoteSet)
urlpatterns = [
    path('', Listing.as_view()),
    path('box/<int:pk>/', views.Box.as_view(name='x')),
    path('gone/', views.missing),
    path('api/', include(router.urls)),
    path('loop/', include('site.urls')),
]
""",
    "shop/views.py": """
@api_view(['GET', 'post'])
def home(request): pass
@decorators.require_POST
def late(request): pass
class Listing(generic.ListView): pass
class Box(View):
    def get(self, r): pass
    def delete(self, r): pass
    def helper(self): pass
class ItemSet(viewsets.ModelViewSet):
    @action(detail=True, methods=['post'], url_path='buy-now')
    def buy(self, r, pk): pass
    @action(detail=unknown, methods=['post'])
    def skipped(self, r): pass
class NoteSet(viewsets.ViewSet):
    def list(self, r): pass
    def destroy(self, r, pk): pass
""",
    "shop/bad.py": "def (",
}
MODULES = [("site.urls", "site/urls.py"), ("shop.urls", "shop/urls.py"), ("shop.views", "shop/views.py")]


def test_endpoints(spark):
    facts = files.python_facts(spark.createDataFrame(list(SOURCES.items()), "path string, text string")).persist()
    modules = spark.createDataFrame(MODULES, "module string, path string")
    got = django.endpoints(facts, modules, spark.createDataFrame([("site/urls.py",)], "path string"))
    assert {(r.method, r.normalized_path): r.def_name for r in got.collect()} == {
        ("GET", "/"): "home", ("POST", "/"): "home",
        ("GET", "/shop/"): "Listing",  # the later pattern of the same path is never reached
        ("GET", "/shop/box/{p0}/"): "Box", ("DELETE", "/shop/box/{p0}/"): "Box",
        ("GET", "/shop/gone/"): None,
        ("GET", "/shop/api/items/"): "ItemSet", ("POST", "/shop/api/items/"): "ItemSet",
        **{(m, "/shop/api/items/{p0}/"): "ItemSet" for m in ("GET", "PUT", "PATCH", "DELETE")},
        ("POST", "/shop/api/items/{p0}/buy-now/"): "ItemSet",
        ("GET", "/shop/api/notes/"): "NoteSet", ("DELETE", "/shop/api/notes/{p0}/"): "NoteSet",
    }


def test_several_definitions_stay_unresolved(spark):
    sources = [("a.py", "from m import f"), ("m1.py", "def f(): pass"), ("m2.py", "def f(): pass")]
    facts = files.python_facts(spark.createDataFrame(sources, "path string, text string"))
    modules = spark.createDataFrame([("m", "m1.py"), ("m", "m2.py")], "module string, path string")
    assert django.resolved(spark.createDataFrame([("a.py", "f")], "path string, expression string"), facts, modules).first().def_path is None


def test_no_files(spark):
    facts = files.python_facts(spark.createDataFrame([], "path string, text string"))
    modules = spark.createDataFrame([], "module string, path string")
    assert django.endpoints(facts, modules, spark.createDataFrame([], "path string")).count() == 0


def test_endpoints_parse_sources_once_and_in_many_tasks(spark, monkeypatch):
    from flowloom import queries as graph
    from flowloom.sources import files as sources

    parsed, seen = sources.python_facts, []
    times = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            times.add(len(batch))
            yield batch

    def facts(rows):
        seen.append(rows.rdd.getNumPartitions())
        return parsed(rows.mapInPandas(counted, "path string, text string"))

    monkeypatch.setattr(graph.files, "python_facts", facts)
    found = graph.queries()["django_endpoints"](spark, "/root/testdata/sf0.001").collect()
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert len(found) == 9 * suppliers
    assert seen == [4] and times.value == 3 * suppliers
